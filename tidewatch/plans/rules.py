"""Rule definitions: the declarative form that jobs are compiled from.

``Rule.from_json`` reads the JSON form; unknown members are ignored, missing ones take
their defaults. Rendering gives the SQL text of selected attributes.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields
from enum import Enum
from typing import Any

#: Output names that a rule can't use itself (fixed values).
RESERVED = ("alarm_level", "alarm_name", "alarm_stage", "alarm_status", "alarm_count", "alarm_content", "alarm_advice")
DEFAULT_ALARM_KEY = ("src_address", "dst_address", "alarm_content")


class Category(Enum):
    UNKNOWN = -1
    SAE = 0
    HQL = 1

    @classmethod
    def of(cls, name: str | int | None) -> Category:
        if isinstance(name, int):
            return next((c for c in cls if c.value == name), cls.UNKNOWN)
        return cls.__members__.get((name or "").upper(), cls.UNKNOWN)


def _read(cls: type, data: dict[str, Any] | None, **more: Any) -> Any:
    known = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in (data or {}).items() if k in known} | more)


@dataclass(frozen=True)
class Event:
    id: str = ""
    name: str = ""
    typeId: str = ""


@dataclass(frozen=True)
class EventDef:
    """An event under its alias, and the predicate that it satisfies."""

    alias: str
    filter: str
    event: Event = Event()

    @classmethod
    def read(cls, d: dict[str, Any]) -> EventDef:
        return cls(d.get("as", d.get("alias", "")), d.get("filter", ""), _read(Event, d.get("event")))


@dataclass(frozen=True)
class Repeat:
    low: int = 1
    high: int | None = None
    changed: bool = False


@dataclass(frozen=True)
class Attribute:
    alias: str
    attrField: str
    attrName: str = ""
    attrType: str = "string"

    @classmethod
    def read(cls, d: dict[str, Any]) -> Attribute:
        return cls(d.get("as", d.get("alias", "")), d.get("attrField", ""), d.get("attrName", ""), d.get("attrType", "string"))

    def text(self, index: int | None = None) -> str:
        return f"{self.alias}.{self.attrField}" if index is None else f"{self.alias}[{index}].{self.attrField}"


@dataclass(frozen=True)
class TimeWindow:
    value: int
    unit: str = "second"
    type: str = "time"
    attr: Attribute | None = None
    changed: bool = False

    @classmethod
    def read(cls, d: dict[str, Any]) -> TimeWindow:
        attr = d.get("attr") or d.get("event")
        return cls(int(d["value"]), d.get("unit", "second"), d.get("type", "time"), Attribute.read(attr) if attr else None, d.get("changed", False))

    @property
    def interval(self) -> str:
        return f"{self.value} {self.unit}"

    def text(self, alias: bool = False, repeated: bool = False) -> str:
        """The window as text, its attribute plain, with its alias, or with the first element of a repeated alias."""
        name = "" if self.attr is None else self.attr.text(0) if repeated else self.attr.text() if alias else self.attr.attrField
        return f".win:{self.type}({name},{self.value} {self.unit})"


@dataclass(frozen=True)
class Select:
    """An output column: an attribute, a function of one, or a constant."""

    alias: str = ""
    attr: Attribute | None = None
    fn: str = ""
    constValue: Any = None
    constType: str = "string"
    tags: tuple[str, ...] = ()

    @classmethod
    def read(cls, d: dict[str, Any]) -> Select:
        attr = d.get("eventAttr") or d.get("attr")
        return cls(d.get("alias", ""), Attribute.read(attr) if attr else None, d.get("fn", ""), d.get("constValue"), d.get("constType", "string"), tuple(d.get("tags", ())))

    def constant(self) -> str:
        kind = self.constType.lower()
        if kind in ("int", "integer", "long", "date"):
            return f"{self.constValue}L"
        if kind in ("float", "double"):
            return f"{self.constValue}F"
        if kind in ("boolean", "bool"):
            return str(self.constValue).lower()
        return "'" + str(self.constValue).replace("'", "''") + "'"

    def text(self) -> str:
        """As SQL; a function without an alias has no text, and reserved names are refused."""
        if self.alias in RESERVED:
            raise ValueError(f"{self.alias} is a reserved name")
        if self.attr is None:
            body = self.constant()
        elif self.fn:
            if not self.alias:
                return ""
            body = f"{self.fn}({self.attr.alias}.`{self.attr.attrField}`)"
        else:
            body = f"{self.attr.alias}.`{self.attr.attrField}`"
        return f"{body} AS `{self.alias}`" if self.alias else body


@dataclass(frozen=True)
class Inner:
    """Whether matches are events of their own, and their name."""

    enabled: bool = False
    name: str = ""


@dataclass(frozen=True)
class Alert:
    enabled: bool = False
    content: str = ""
    level: int = 0
    stage: str = ""
    ruleType: str = ""
    advice: str = ""
    tags: tuple[str, ...] = ()
    alarmKey: tuple[str, ...] = DEFAULT_ALARM_KEY
    attack: dict[str, Any] = field(default_factory=dict)
    playbooks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Having:
    """The threshold of a windowed rule: fn (count, distinct, sum) of a field, op and value."""

    fn: str = "count"
    field: str = ""
    op: str = ">="
    value: float = 1


@dataclass(frozen=True)
class Rule:
    name: str
    family: str
    events: tuple[EventDef, ...]
    id: str = ""
    desc: str = ""
    status: str = ""
    templateId: str = ""
    selects: tuple[Select, ...] = ()
    window: TimeWindow | None = None
    slide: TimeWindow | None = None
    groupBy: tuple[str, ...] = ()
    relation: tuple[tuple[str, str], ...] = ()
    where: str = ""
    patternRepeat: Repeat = Repeat()
    skip: str = "past_last"
    contiguity: str = "relaxed"
    innerEvent: Inner = Inner()
    having: dict[str, Having] = field(default_factory=dict)
    alert: Alert = Alert()
    category: Category = Category.UNKNOWN
    silence: str | None = None
    sysId: str | None = None

    @property
    def builtin(self) -> bool:
        return self.sysId is not None

    @property
    def key(self) -> str:
        """The id, or a digest of the name."""
        return self.id or hashlib.md5(self.name.encode()).hexdigest()

    def event(self, alias: str) -> EventDef:
        return next(e for e in self.events if e.alias == alias)

    @classmethod
    def from_json(cls, text: str | dict[str, Any]) -> Rule:
        d = json.loads(text) if isinstance(text, str) else text
        window = lambda k: TimeWindow.read(d[k]) if d.get(k) else None
        alert = {k: tuple(v) if isinstance(v, list) else v for k, v in (d.get("alert") or {}).items()}
        return cls(
            name=d["name"], family=d.get("family", d.get("templateId", "")), events=tuple(map(EventDef.read, d.get("events", ()))), id=d.get("id", ""), desc=d.get("desc", ""), status=str(d.get("status", "")), templateId=str(d.get("templateId", "")),
            selects=tuple(map(Select.read, d.get("selects", ()))), window=window("window"), slide=window("slide"), groupBy=tuple(d.get("groupBy", ())), relation=tuple(map(tuple, d.get("relation", ()))), where=d.get("where", ""),
            patternRepeat=_read(Repeat, d.get("patternRepeat")), skip=d.get("skip", "past_last"), contiguity=d.get("contiguity", "relaxed"), innerEvent=_read(Inner, d.get("innerEvent")), having={k: _read(Having, v) for k, v in (d.get("having") or {}).items()}, alert=_read(Alert, alert), category=Category.of(d.get("ruleCategory")), silence=d.get("silence"), sysId=d.get("sysId"),
        )
