import hashlib
import itertools
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import pii as K


def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], K.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("019 .-+()@aZ%é\n"), max_size=40))
def test_base_spans(t):
    assert K.base_spans(t) == plain(t)


def test_base_examples():
    for t in ["x@a.com@b.org", "a@b@c.com", "@a.b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0199.", "+" + "1" * 20, "9" * 3000 + ".1.1.1", "a." * 4000 + "@x"]:
        assert K.base_spans(t) == plain(t)


def test_the_field_adds_other_spellings_and_leaves_the_rest():
    w = K.weights()
    want, found, wrong = Counter(), Counter(), 0
    for text, spans in [*K._examples(400, seed=99), *K._examples(400, seed=7)]:
        base, every = K.find(text, w)
        added, real = set(every) - set(base), {s for s in spans if not any(b[1] < s[2] and s[1] < b[2] for b in base)}
        want.update(s[0] for s in real)
        found.update(s[0] for s in added & real)
        wrong += len(added - real)
    assert all(found[k] >= 0.9 * want[k] and want[k] > 20 for k in K.KINDS), (found, want)
    assert wrong <= 0.02 * want.total()
    for text, span in {
        "Write to jane (at) example (dot) org for details.": "jane (at) example (dot) org", "You can reach me at bob [at] mail [dot] example [dot] com today.": "bob [at] mail [dot] example [dot] com", "Questions? Mail info @ example.com please": "info @ example.com",
        "The server 10[.]20[.]30[.]40 was seen.": "10[.]20[.]30[.]40", "Our office number is (212) 555-0147, ask for Ann.": "(212) 555-0147", "Fax 212-555-0199 or write": "212-555-0199", "He paid with 4111 - 1111 - 1111 - 1111 last week": "4111 - 1111 - 1111 - 1111",
    }.items():
        assert [text[s:e] for _, s, e in K.find(text, w)[1]] == [span]
    for clean in ["Version 2.0 of 2024-01-31, see 12345678.", "token = \"9807915762804490ab\"", "meet me at noon", "a 16 digit 9807915762804491 number", "@handle and 3.14", "we met at dot com (at noon)", "the shop (at Main Street) is open. The dot in the text"]:
        assert K.find(clean, w) == ([], [])
    base, every = K.find("call (212) 555-0199 or jane@example.com", w)
    assert base == [("email", 23, 39)] and ("phone", 5, 19) in every


def test_redaction():
    assert K.redact("a 1.2.3.4 b", [("ip", 2, 9)]) == "a [IP] b"
    assert K.redact("+123456789012", [("phone", 0, 13), ("card", 1, 13)]) == "[PHONE]"
    assert K.redact("x", []) == "x"


def test_awkward_documents(spark):
    got = K.detect(frame(spark)).collect()
    want = []
    for i, t, _ in AWKWARD:
        base = plain(t or "")
        want.append((i, *(sum(s[0] == k for s in base) for k in K.KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    df = frame(spark)
    out = K.redacted(df)
    assert out.columns == df.columns and out.count() == len(AWKWARD)
    assert {r.text for r in out.where("doc_id IS NULL").collect()} == {None, "no id here, but a mail: [EMAIL] and [PHONE]"}
    assert out.where("n_chars <> length(text)").isEmpty()
    assert K.detect(frame(spark, [])).isEmpty() and K.redacted(frame(spark, [])).isEmpty()


def test_no_quadratic_scan():
    w = K.weights()
    for t in ["1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+" * 200_000, "(" * 100_000]:
        K.find(t, w)


def test_a_long_island_is_decoded_whole():
    w = K.weights()
    text, want = "call ", []
    while len(text) < 13_000:  # three of the former borders, at multiples of 4096
        want.append(("phone", len(text), len(text) + 14))
        text += f"({200 + len(want) % 700}) 555-{1000 + len(want):04d}, "
    assert K.find(text, w) == ([], want)
    for shift in range(20):
        line = "x" * shift + " " + "(212) 555-0147, " * 300
        assert sum(k == "phone" for k, _, _ in K.find(line, w)[1]) == 300
        assert not re.search("[0-9]", K.redact(line, K.find(line, w)[1]))


def test_every_trained_spelling_is_found():
    w, rng = K.weights(), np.random.default_rng(11)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 9)))
    area = lambda: str(rng.integers(2, 10)) + num(2)
    end = lambda: rng.choice(["com", "org", "net"])
    quads = lambda: [str(x) for x in rng.integers(0, 256, 4)]

    def card(sep):
        body = "4" + num(14)
        d = next(body + str(c) for c in range(10) if K.luhn(body + str(c)))
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    spellings = {
        "(a) b-c": ("phone", lambda: f"({area()}) {num(3)}-{num(4)}"), "a-b-c": ("phone", lambda: f"{area()}-{num(3)}-{num(4)}"), "a.b.c": ("phone", lambda: f"{area()}.{num(3)}.{num(4)}"), "1-a-b-c": ("phone", lambda: f"1-{area()}-{num(3)}-{num(4)}"),
        "card .": ("card", lambda: card(".")), "card -": ("card", lambda: card(" - ")), "(at) (dot)": ("email", lambda: f"{word()} (at) {word()} (dot) {end()}"), "[at] [dot]": ("email", lambda: f"{word()} [at] {word()} [dot] {end()}"),
        " @ ": ("email", lambda: f"{word()} @ {word()}.{end()}"), "(at)": ("email", lambda: f"{word()}(at){word()}.{end()}"), "ip  .": ("ip", lambda: ".".join(quads()).replace(".", " .").replace(" .", ".", 2)), "ip [.]": ("ip", lambda: "[.]".join(quads())),
    }
    recall = {}
    for name, (kind, make) in spellings.items():
        hits = 0
        for _ in range(60):
            value, before = make(), word() + " "
            text = before + value + rng.choice([" ", ", ", ". "]) + word() + " " + word()
            hits += (kind, len(before), len(before) + len(value)) in K.find(text, w)[1]
        recall[name] = hits / 60
    assert min(recall.values()) >= 0.9, recall
    for ip in ("192[.]168[.]10[.]27", "10[.]0[.]0[.]1"):  # no other seed nearby
        assert K.redact(ip, K.find(ip, w)[1]) == "[IP]"


def segmentations(n):
    """All ways to take apart n tokens into single ones outside entities and labelled entities, as lists of (i, j, kind)."""
    if n == 0:
        yield []
        return
    for head in segmentations(n - 1):
        yield head
    for i in range(max(0, n - K.MAX_TOKENS), n):
        for head in segmentations(i):
            for kind in range(len(K.KINDS)):
                yield [*head, (i, n, kind)]


def test_the_dynamic_program_against_all_segmentations():
    rng = np.random.default_rng(4)
    for text in ("a@b.c", "(1) 2-3", "1.2 a"):
        tokens = [m[0] for m in K._TOKEN.finditer(text)]
        at = np.cumsum([0, *map(len, tokens)]).tolist()
        for _ in range(6):
            w = rng.normal(0, 1.5, (len(K.KINDS), len(K._FEATURES)))
            segs, feats = K._lattice(tokens)
            score = {(i, j, k): s for (i, j), row in zip(segs.tolist(), feats @ w.T, strict=True) for k, s in enumerate(row)}
            every = [(sum(score[x] for x in seg), seg) for seg in segmentations(len(tokens)) if all(x in score for x in seg)]
            z = np.logaddexp.reduce([v for v, _ in every])
            best = max(every, key=lambda x: x[0])[1]
            likely = [x for x in best if np.logaddexp.reduce([v for v, seg in every if x in seg]) - z >= np.log(K.LEAST_PROBABILITY)]
            touches = lambda s, e: (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())  # noqa: B023, E731
            want = [(K.KINDS[k], at[i], at[j]) for i, j, k in likely if not touches(at[i], at[j])]
            assert K._decode(text, 0, len(text), w) == want
            sums = K._sums(np.array([[np.logaddexp.reduce([score.get((j - 1 - k, j, c), -np.inf) for c in range(4)]) if j > k else -np.inf for k in range(K.MAX_TOKENS)] for j in range(len(tokens) + 1)]))
            assert np.isclose(sums[0][-1], z) and np.isclose(sums[1][0], z)


def test_the_gradient_against_differences():
    rng = np.random.default_rng(5)
    like = K._Likelihood(list(K._examples(12, seed=8)))
    w = rng.normal(0, 0.3, (len(K.KINDS), len(K._FEATURES)))
    grad = like(w)[1]
    for k, f in itertools.product(range(len(K.KINDS)), range(0, len(K._FEATURES), 3)):
        step = np.zeros_like(w)
        step[k, f] = 1e-5
        assert abs((like(w + step)[0] - like(w - step)[0]) / 2e-5 - grad[k, f]) < 1e-5


def test_long_texts_and_ties():
    w = K.weights()
    text = "plain words go here. " * 40_000 + "call (212) 555-0147 now"
    assert K.find(text, w) == ([], [("phone", len(text) - 18, len(text) - 4)])
    # without any preference no entity is taken
    assert K._decode("call (212) 555-0147 now", 0, 23, np.zeros_like(w)) == []
