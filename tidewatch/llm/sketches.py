"""Document fingerprints as invertible Bloom lookup sketches, in SQL expressions alone.

A text is the set of its paragraphs' digests. A paragraph is a line; a line of more than
``LONG_LINE`` characters has one for each sentence, so a text of one long line has
several (a sentence ends after a full stop that a blank follows). A digest is 44
bits of a hash below 20 bits that check them. The
digests are dealt by a hash to blocks, a power of two of them with up to
``DIGESTS_A_BLOCK`` digests each on average, so the work stays in proportion to a text
however long it is. Each block is a sketch of three parts of ``c`` cells; a digest goes
into one cell of each part, where the count and the exclusive or of its digests are kept.

Two sketches of one size are subtracted cell by cell: what both texts have cancels out.
Peeling recovers the rest: a cell with one digest, proved by the check, gives it away;
it is taken out of its other cells, which may leave others alone, until all cells are
empty. If peeling gets stuck, it is tried again with twice the cells, as often as needed.

That is possible without the texts because a fingerprint is built large enough to be
peeled by itself: its cells are doubled until that works. A larger sketch, or one with
more blocks, is made from the digests peeled out of the fingerprint. The likeness of two
fingerprints is the number of digests they share over that of all digests, and is a
function of the two alone, as ``likeness_of_texts`` shows. The text form of a
fingerprint can be read back without loss.

The document before another one in descending order is found over narrow keys; then
each text is shuffled once by its key, and the first half of it once more to the
document whose edited text takes it.

Defined results: null text counts as empty; two empty texts are alike (1), an empty and
another one are not (0). Ids are numbers or text. Equal ids follow each other by the
hash of the text, and rows equal in both follow each other, each the next one's
document; null ids come last. A table of one row is its own next document. Rows are
never dropped. Texts that differ only in the order or repetition of paragraphs have
equal fingerprints. Two different paragraphs of a pair of texts count as one with
probability 2**-44. Two digests that share the low 42 bits and not all 44 (probability
2**-42 for two of a block) can't be told apart by a sketch of any size: a block with two
such is kept as the list of its digests, and blocks that differ by such are compared as sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.runtime import ranged, table

LONG_LINE = 600
DIGESTS_A_BLOCK = 8
ROUNDS = 32
_DOUBLINGS = 12
_LOW = (1 << 44) - 1
_PART_BITS = 14
_KEY = ["kn", "ki", "kh"]


def digests(text: str) -> str:
    """The distinct paragraph digests of a text."""
    lines = rf"array_join(transform(split({text}, '\n'), l -> if(length(l) > {LONG_LINE}, replace(l, '. ', '.\n'), l)), '\n')"
    return rf"array_distinct(transform(filter(split({lines}, '\n'), p -> p <> ''), p -> {_checked('xxhash64(p)')}))"


def _checked(digest: str) -> str:
    """The low 44 bits of a hash, below 20 bits that check them."""
    low = f"({digest} & {_LOW}L)"
    return f"({low} | shiftleft(xxhash64({low}, 99), 44))"


def _place(digest: str, part: str, cells: str) -> str:
    """The digest's cell in a part; the parts go by different bits of it."""
    return f"(shiftrightunsigned({digest}, {_PART_BITS} * {part}) & ({cells} - 1))"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _doubled(start: str, size: str, attempt: str, kind: str, otherwise: str) -> str:
    """The first result of ``attempt`` that isn't null, with ``size`` from ``start`` up, doubled each time; ``otherwise`` if no size will do."""
    ladder = f"aggregate(sequence(0, {_DOUBLINGS}), cast(null as {kind}), (res, r) -> coalesce(res, {_bind(f'shiftleft({start}, r)', size, attempt)}))"
    return f"coalesce({ladder}, {otherwise})"


def sketch(of: str, cells: str) -> str:
    """The cells of a set of digests, part after part, each with its number ``i``."""
    cell = "named_struct('i', j * c0 + i, 'n', size(m), 'k', aggregate(m, 0L, (s, d) -> s ^ d))".replace("c0", cells)
    mine = f"filter({of}, d -> {_place('d', 'j', cells)} = i)"
    return f"flatten(transform(array(0, 1, 2), j -> transform(sequence(0, {cells} - 1), i -> {_bind(mine, 'm', cell)})))"


def difference(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('i', x.i, 'n', x.n - y.n, 'k', x.k ^ y.k))"


_SIGNED = "array<struct<k: bigint, n: int>>"
_CELLS = "array<struct<i: int, n: int, k: bigint>>"
_BLOCK = f"struct<c: int, s: {_CELLS}, h: array<bigint>>"
_FULL = "x -> x.n <> 0 OR x.k <> 0"


def peel(cells: str, size: str, signed: bool = False) -> str:
    """How many digests a difference holds, or null if peeling gets stuck. ``signed``: the digests ``k`` themselves, with ``n`` 1 if the first side has it and -1 if the second."""
    none, more, kind = (f"cast(array() as {_SIGNED})", "concat(st.f, transform(p, q -> named_struct('k', q.k, 'n', q.n)))", _SIGNED) if signed else ("0", "st.f + size(p)", "int")
    alone = f"filter(st.c, x -> (x.n = 1 OR x.n = -1) AND x.k = {_checked('x.k')} AND {_place('x.k', f'(x.i div {size})', size)} = x.i % {size})"
    places = ", ".join(f"'p{j}', cast({_place('d', str(j), size)} as int) + {j} * {size}" for j in range(3))
    side = lambda n: f"transform(array_distinct(transform(filter(l, x -> x.n = {n}), x -> x.k)), d -> named_struct('k', d, 'n', {n}, {places}))"
    without = f"filter(transform(st.c, x -> aggregate(p, x, (s, q) -> if(s.i = q.p0 OR s.i = q.p1 OR s.i = q.p2, named_struct('i', s.i, 'n', s.n - q.n, 'k', s.k ^ q.k), s))), {_FULL})"
    step = _bind(_bind(alone, "l", f"concat({side(1)}, {side(-1)})"), "p", f"if(size(p) = 0, named_struct('c', st.c, 'f', st.f, 'go', false), named_struct('c', {without}, 'f', {more}, 'go', size(st.c) > size(p)))")
    peeled = f"aggregate(sequence(1, {ROUNDS}), named_struct('c', filter({cells}, {_FULL}), 'f', {none}, 'go', true), (st, r) -> if(st.go, {step}, st))"
    return _bind(peeled, "e", f"if(size(e.c) = 0, e.f, cast(null as {kind}))")


def _listed(cells: str, size: str) -> str:
    """The digests of a sketch, or null if it is too small."""
    return f"transform({peel(cells, size, signed=True)}, x -> x.k)"


def _block(of: str) -> str:
    """The sketch of a block: about two cells a digest, more until it can be peeled by itself; ``h`` is what peeling gives.

    Digests that fall into the same cells at every size are no sketch's: such a block has size 0 and a cell for each digest.
    """
    start = "case when n <= 3 then 2 when n <= 6 then 4 when n <= 12 then 8 when n <= 24 then 16 when n <= 48 then 32 else 64 end"
    plain = _bind("array_sort(b)", "o", "named_struct('c', 0, 's', transform(o, (x, i) -> named_struct('i', i, 'n', 1, 'k', x)), 'h', o)")
    attempt = _bind(sketch("b", "c"), "t", _bind(_listed("t", "c"), "h", f"if(h IS NULL, cast(null as {_BLOCK}), named_struct('c', c, 's', t, 'h', h))"))
    return _bind(of, "b", _bind(_bind("size(b)", "n", start), "m", _doubled("m", "c", attempt, _BLOCK, plain)))


def _bits(of: str) -> str:
    """The number of blocks, as a power of two, for so many digests."""
    return f"aggregate(sequence(0, 40), 0, (b, r) -> if(shiftleft({DIGESTS_A_BLOCK}L, b) < {of}, b + 1, b))"


def fingerprint(of: str, bits: str | None = None) -> str:
    """The blocks of a set of digests. They are dealt in two steps of about the square root of their number each."""
    hashed = "xxhash64(h, 1)"
    inner = _block(f"if(v.y = 0, z, filter(z, h -> shiftrightunsigned({hashed}, v.x) & (shiftleft(1L, v.y) - 1) = u2))")
    outer = _bind(f"if(v.x = 0, {of}, filter({of}, h -> {hashed} & (shiftleft(1L, v.x) - 1) = u1))", "z", f"transform(sequence(0, shiftleft(1, v.y) - 1), u2 -> {inner})")
    split = _bind(bits or _bits(f"size({of})"), "b", "named_struct('x', b div 2, 'y', b - b div 2)")
    return _bind(_bind(split, "v", "named_struct('x', cast(v.x as int), 'y', cast(v.y as int))"), "v", f"flatten(transform(sequence(0, shiftleft(1, v.x) - 1), u1 -> {outer}))")


def count(blocks: str) -> str:
    """How many digests a fingerprint holds."""
    return f"aggregate({blocks}, 0L, (t, b) -> t + size(b.h))"


def differing(a: str, b: str, signed: bool = False) -> str:
    """The number of digests that one of two fingerprints has and the other hasn't; ``signed``: the digests, as from ``peel``."""
    kind = _SIGNED if signed else "int"
    # what no size tells apart is compared as sets
    sides = [f"array_except({x}.h, {y}.h)" for x, y in (("bx", "by"), ("by", "bx"))]
    plain = f"concat({', '.join(f'transform({s}, q -> named_struct({chr(39)}k{chr(39)}, q, {chr(39)}n{chr(39)}, {n}))' for s, n in zip(sides, (1, -1), strict=True))})" if signed else f"size({sides[0]}) + size({sides[1]})"
    again = _doubled("m", "c", peel(difference(sketch("bx.h", "c"), sketch("by.h", "c")), "c", signed), kind, plain)
    retried = _bind("if(bx.c = by.c, 2 * bx.c, greatest(bx.c, by.c))", "m", again)
    once = _bind("bx.c", "c", peel(difference("bx.s", "by.s"), "c", signed))
    each = f"if(bx.c = 0 OR by.c = 0, {plain}, coalesce(if(bx.c = by.c, {once}, cast(null as {kind})), {retried}))"
    # the one with fewer blocks is made again from its digests, with as many as the other
    grown = lambda p, q: f"if(size({p}) < size({q}), {_bind(f'flatten(transform({p}, b -> b.h))', 'l', fingerprint('l', f'cast(round(log2(size({q}))) as int)'))}, {p})"
    parts = _bind(f"named_struct('a', {grown(a, b)}, 'b', {grown(b, a)})", "g", f"zip_with(g.a, g.b, (bx, by) -> {each})")
    return f"flatten({parts})" if signed else f"aggregate({parts}, 0, (t, q) -> t + q)"


def likeness(a: str, b: str) -> str:
    """Shared over all digests of two fingerprints."""
    counted = f"named_struct('both', {count(a)} + {count(b)}, 'd', {differing(a, b)})"
    return _bind(counted, "d", "if(d.both = 0, 1D, cast(d.both - d.d as double) / (d.both + d.d))")


def as_text(blocks: str) -> Column:
    """A fingerprint as text: for each block the cells a part, then the cells, each as count and digests in hexadecimal; an empty cell is an empty string."""
    cell = "if(x.n = 0 AND x.k = 0, '', concat_ws('.', hex(x.n), hex(x.k)))"
    return F.expr(f"lower(array_join(transform({blocks}, b -> concat(b.c, ';', array_join(transform(b.s, x -> {cell}), ','))), '|'))")


def from_text(text: str) -> str:
    """The blocks of a fingerprint's text form."""
    number = lambda k: f"coalesce(cast(conv(get(p, {k}), 16, -10) as bigint), 0L)"
    cell = _bind("split(x, '[.]')", "p", f"named_struct('i', r, 'n', cast({number(0)} as int), 'k', {number(1)})")
    cells = f"transform(split(get(split(b, ';'), 1), ','), (x, r) -> {cell})"
    block = _bind("cast(get(split(b, ';'), 0) as int)", "c", _bind(cells, "t", f"named_struct('c', c, 's', t, 'h', if(c = 0, transform(t, x -> x.k), {_listed('t', 'c')}))"))
    return f"transform(split({text}, '[|]'), b -> {block})"


def likeness_of_texts(df: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """``df`` with the ``likeness`` of the fingerprints whose text form is in the columns ``a`` and ``b``."""
    read = df.withColumns({"tw_fa": F.expr(from_text(a)), "tw_fb": F.expr(from_text(b))})
    return read.withColumn(name, F.expr(likeness("tw_fa", "tw_fb"))).drop("tw_fa", "tw_fb")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # the id itself is left out, so that both readings of the texts are the same and shuffled once
    return rows.select(F.col("doc_id").isNull().alias("kn"), F.coalesce("doc_id", F.lit(0).cast(rows.schema["doc_id"].dataType)).alias("ki"), F.xxhash64("text").alias("kh"), "text")


def _previous(rows: DataFrame) -> DataFrame:
    """For each key: how many rows have it, and key and length of the document before it in descending order; the first one's is the last."""
    keys = rows.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    order = [F.col("kn").asc(), F.col("ki").desc(), F.col("kh").asc()]
    own, inside = F.struct(*_KEY, "n"), Window.partitionBy("bucket").orderBy(*order)
    placed = ranged(keys, order, "bucket").withColumns({"p": F.lag(own).over(inside), "last": F.lead("kh").over(inside).isNull()})
    # one row for each partition
    every = Window.orderBy("bucket")
    ends = placed.where("last").select("bucket", own.alias("end"))
    before = ends.select("bucket", F.coalesce(F.lag("end").over(every), F.last("end").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    return placed.join(F.broadcast(before), "bucket").withColumn("p", F.coalesce("p", "before")).select(*_KEY, "copies", *[F.col(f"p.{c}").alias(f"p{c}") for c in [*_KEY, "n"]])


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited`` and the digests ``tw_d``, ``tw_e``, ``tw_f`` of the text, the edited text and the next document's."""
    rows = _keyed(docs, doc_id, text)
    placed = rows.join(_previous(rows), _KEY).withColumn("copy", F.row_number().over(Window.partitionBy(*_KEY).orderBy("ki")))
    placed = placed.withColumn("n_chars", F.length("text")).withColumn("half", F.expr("cast(floor(n_chars / 2) as int)"))
    sent = placed.where("copy = 1").select(*[F.col(f"p{c}").alias(c) for c in _KEY], F.expr("substring(text, 1, cast(floor(pn / 2) as int))").alias("head"), F.expr(digests("text")).alias("tw_f"))
    got = placed.join(sent, _KEY).withColumn("tw_d", F.expr(digests("text")))
    # all copies but the last are followed by a copy of themselves
    head = F.when(F.col("copy") < F.col("copies"), F.expr("substring(text, 1, half)")).otherwise(F.col("head"))
    edited = F.concat(F.expr("substring(text, 1, n_chars - half)"), head)
    after = F.when(F.col("copy") < F.col("copies"), F.col("tw_d")).otherwise(F.col("tw_f"))
    return got.select(F.when(~F.col("kn"), F.col("ki")).alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"), edited.alias("edited"), "tw_d", after.alias("tw_f")).withColumn("tw_e", F.expr(digests("edited")))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and the likeness of the first to the second and to the next document's."""
    rows = with_next(docs, doc_id, text).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    for v in "def":  # the prefix keeps columns apart from the names in lambdas
        rows = rows.withColumn(f"tw_s{v}", F.expr(fingerprint(f"tw_{v}")))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text("tw_sd").alias("fingerprint"), as_text("tw_se").alias("edited_fingerprint"), F.expr(likeness("tw_sd", "tw_se")).alias("near_edited"), F.expr(likeness("tw_sd", "tw_sf")).alias("near_next"))


def op3_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
