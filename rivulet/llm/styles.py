"""What a page's style sheets say about ``display`` and ``visibility``.

Only these two properties decide whether text shows, so a sheet is reduced to
the rules that set them. At-rules: ``@media`` counts if it holds on a screen of
``WIDTH`` x ``HEIGHT`` pixels, ``@supports`` and ``@layer`` always; all others
say nothing of the page itself. Selectors: compound ones of tags, classes, ids,
attributes and structural pseudo-classes, with all four combinators. One with a
state that a page at rest has not (``:hover``), or with a pseudo-element, names
no element. The cascade goes by importance, place (inline or sheet),
specificity, and order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WIDTH, HEIGHT = 1280, 800
DISPLAYS = frozenset(
    "none block inline inline-block contents flex inline-flex grid inline-grid flow-root list-item run-in math ruby table inline-table table-row table-cell table-column table-caption"
    " table-row-group table-header-group table-footer-group table-column-group ruby-base ruby-text -webkit-box -webkit-inline-box -webkit-flex -ms-flexbox initial inherit unset revert".split()
)
VISIBILITIES = frozenset("visible hidden collapse initial inherit unset revert".split())
_NAME = r"(?:[a-zA-Z0-9_-]|[^\x00-\x7F]|\\.)+"
_PART = re.compile(rf"(\*)|({_NAME})|\.({_NAME})|#({_NAME})|\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*([iIsS])?\s*)?\]|(::?)([\w-]+)(?:\(((?:[^()]|\([^()]*\))*)\))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_PIECE = re.compile(r"""[^{};"'\\]+|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|\\.|[{};]""", re.S)


def _bare(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


@dataclass
class Compound:
    tag: str = ""
    ids: list = field(default_factory=list)
    classes: list = field(default_factory=list)
    attributes: list = field(default_factory=list)
    pseudo: list = field(default_factory=list)  # (name, selectors)

    def weight(self) -> tuple[int, int, int]:
        a, b, c = len(self.ids), len(self.classes) + len(self.attributes), int(bool(self.tag))
        for name, inner in self.pseudo:
            if name in ("not", "is"):
                x, y, z = max((s.weight for s in inner), default=(0, 0, 0))
                a, b, c = a + x, b + y, c + z
            elif name != "where":
                b += 1
        return a, b, c

    def fits(self, node) -> bool:
        if self.tag and node.tag != self.tag:
            return False
        a = node.attrs
        if self.ids and any(a.get("id") != i for i in self.ids):
            return False
        if self.classes:
            own = a.get("class", "").split()
            if any(c not in own for c in self.classes):
                return False
        return all(_attribute(a, *x) for x in self.attributes) and all(_pseudo(node, *x) for x in self.pseudo)


def _attribute(attrs: dict, name: str, how: str, value: str, plain: bool) -> bool:
    if name not in attrs:
        return False
    if not how:
        return True
    got = attrs[name].lower() if plain else attrs[name]
    value = value.lower() if plain else value
    if how == "~=":
        return value in got.split()
    if how == "|=":
        return got == value or got.startswith(value + "-")
    if how in ("^=", "$=", "*="):
        return bool(value) and (got.startswith(value) if how == "^=" else got.endswith(value) if how == "$=" else value in got)
    return got == value


def _pseudo(node, name: str, inner: list) -> bool:
    if name == "not":
        return not any(s.fits(node) for s in inner)
    if name in ("is", "where"):
        return any(s.fits(node) for s in inner)
    if name == "root":
        return node.parent is None
    if name in ("link", "any-link"):
        return node.tag in ("a", "area") and "href" in node.attrs
    if name == "empty":
        return not node.children
    if name in ("checked", "disabled"):
        return name in node.attrs or name == "checked" and "selected" in node.attrs
    if name == "enabled":
        return node.tag in ("button", "input", "select", "textarea", "option") and "disabled" not in node.attrs
    around = [x for x in node.parent.children if not isinstance(x, str)] if node.parent else [node]
    if name.endswith("of-type"):
        around = [x for x in around if x.tag == node.tag]
    first, last = around[0] is node, around[-1] is node
    return first if name.startswith("first") else last if name.startswith("last") else first and last


_STRUCTURE = frozenset("root link any-link empty checked disabled enabled first-child last-child only-child first-of-type last-of-type only-of-type".split())


@dataclass
class Selector:
    """Compounds from right to left, and the combinator that stands left of each but the last."""

    compounds: list
    joins: list

    def __post_init__(self):
        self.weight = tuple(map(sum, zip(*[c.weight() for c in self.compounds], strict=True)))

    def fits(self, node, at: int = 0, failed: set | None = None) -> bool:
        """Whether the compounds from ``at`` on name ``node`` and what stands around it; ``failed`` keeps the attempts so far."""
        if not self.compounds[at].fits(node):
            return False
        if at + 1 == len(self.compounds):
            return True
        failed = set() if failed is None else failed
        if (node, at) in failed:
            return False
        join = self.joins[at]
        other = node.parent if join in " >" else node.before
        while other is not None:
            if self.fits(other, at + 1, failed):
                return True
            other = None if join in ">+" else other.parent if join == " " else other.before
        failed.add((node, at))
        return False


def selector(text: str) -> Selector | None:
    """The selector, or nothing if it names no element of a page at rest or cannot be read."""
    at, compounds, joins, now = 0, [], [], None
    text = text.strip()
    while at < len(text):
        if m := re.compile(r"\s*([>+~])\s*|\s+").match(text, at):
            if now is None:
                return None
            joins.append(m[1] or " ")
            now, at = None, m.end()
            continue
        m = _PART.match(text, at)
        if not m:
            return None
        if now is None:
            compounds.append(now := Compound())
        any_, tag, cls, id_, name, how, *values, flag, colon, pseudo, inside = m.groups()
        if tag:
            now.tag = _bare(tag).lower()
        elif cls:
            now.classes.append(_bare(cls))
        elif id_:
            now.ids.append(_bare(id_))
        elif name:
            now.attributes.append((_bare(name).lower(), how or "", next((v for v in values if v is not None), ""), (flag or "").lower() == "i"))
        elif pseudo:
            pseudo = pseudo.lower()
            inner = [selector(s) for s in split(inside or "", ",")] if pseudo in ("not", "is", "where") and inside else []
            if colon == "::" or not inner and pseudo not in _STRUCTURE:
                return None
            if pseudo == "not":
                inner = [s for s in inner if s]  # what never holds is never in the way
            elif inner and not (inner := [s for s in inner if s]):
                return None
            now.pseudo.append((pseudo, inner))
        at = m.end()
    if now is None:
        return None
    return Selector(compounds[::-1], joins[::-1])


def split(text: str, sign: str) -> list[str]:
    """Pieces between signs that stand outside brackets and quotes."""
    out, depth, quote, begin = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[k - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == sign and not depth:
            out.append(text[begin:k])
            begin = k + 1
    return [*out, text[begin:]]


def declared(body: str) -> dict[str, tuple[str, bool]]:
    """``display`` and ``visibility`` as set by declarations: value, and whether it is important."""
    out: dict[str, tuple[str, bool]] = {}
    for part in split(body, ";"):
        name, sign, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = bool(re.search(r"!\s*important$", value))
        value = re.sub(r"!\s*important$", "", value).strip()
        if not sign or name not in ("display", "visibility"):
            continue
        if name == "display" and value not in DISPLAYS and not re.fullmatch(r"(?:block|inline) [\w-]+", value) or name == "visibility" and value not in VISIBILITIES:
            continue
        if name not in out or important >= out[name][1]:
            out[name] = value, important
    return out


def on_screen(query: str, width: int = WIDTH, height: int = HEIGHT) -> bool:
    """Whether a media query list holds on such a screen."""
    return any(_holds(q.strip().lower(), width, height) for q in query.split(","))


def _holds(query: str, width: int, height: int) -> bool:
    if not query:
        return True
    if turned := query.startswith("not "):
        query = query[4:].strip()
    ok = True
    for part in re.split(r"\s+and\s+", query.removeprefix("only ").strip()):
        part = part.strip()
        ok = ok and (_feature(part[1:-1], width, height) if part.startswith("(") else part in ("all", "screen"))
    return ok != turned


def _feature(text: str, width: int, height: int) -> bool:
    sizes = {"width": width, "height": height, "device-width": width, "device-height": height}

    def pixels(value: str) -> float | None:
        m = re.fullmatch(r"\s*([\d.]+)\s*(px|em|rem|)\s*", value)
        return float(m[1]) * (16 if m[2] in ("em", "rem") else 1) if m else None

    if m := re.fullmatch(r"\s*(?:([\d.]+\w*)\s*(<=?|>=?)\s*)?([\w-]+)\s*(?:(<=?|>=?)\s*([\d.]+\w*))?\s*", text):
        if m[3] in sizes and (m[2] or m[4]):
            have, ok = sizes[m[3]], True
            for value, sign, left in ((m[1], m[2], True), (m[5], m[4], False)):
                if sign:
                    x = pixels(value)
                    a, b = (x, have) if left else (have, x)
                    ok = ok and x is not None and (a < b if sign == "<" else a <= b if sign == "<=" else a > b if sign == ">" else a >= b)
            return ok
    name, sign, value = text.partition(":")
    name, value = name.strip(), value.strip()
    low, _, plain = name.partition("-")
    if low in ("min", "max") and plain in sizes:
        x = pixels(value)
        return x is not None and (sizes[plain] >= x if low == "min" else sizes[plain] <= x)
    if name in sizes:
        return not sign or pixels(value) == sizes[name]
    held = {"orientation": "landscape" if width >= height else "portrait", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "scripting": "enabled", "color": ""}
    return name in held and (not sign or value == held[name])


class Sheets:
    """Rules of a page, by what the rightmost compound of a selector asks for."""

    def __init__(self):
        self.rules: dict[tuple[str, str], list] = {}
        self.count = 0

    def add(self, css: str, media: str = "") -> None:
        if on_screen(media):
            pieces = _PIECE.findall(_COMMENT.sub(" ", css))
            self._read(pieces, 0)

    def _read(self, pieces: list[str], at: int) -> int:
        """Rules up to the end of the block that begins at ``at``."""
        head: list[str] = []
        while at < len(pieces):
            p = pieces[at]
            at += 1
            if p == "}":
                return at
            if p == ";":
                head = []
                continue
            if p != "{":
                head.append(p)
                continue
            name = "".join(head).strip()
            head = []
            if not name.startswith("@"):
                begin, depth = at, 1
                while at < len(pieces) and depth:
                    depth += (pieces[at] == "{") - (pieces[at] == "}")
                    at += 1
                self._rule(name, "".join(pieces[begin : at - (depth == 0)]))
                continue
            kind, _, rest = name[1:].partition(" ")
            kind = kind.partition("(")[0].lower()
            rest = name[1 + len(kind) :].strip()
            if kind == "media" and on_screen(rest) or kind in ("supports", "layer"):
                at = self._read(pieces, at)
            else:
                depth = 1
                while at < len(pieces) and depth:
                    depth += (pieces[at] == "{") - (pieces[at] == "}")
                    at += 1
        return at

    def _rule(self, selectors: str, body: str) -> None:
        if not (how := declared(body)):
            return
        for s in map(selector, split(selectors, ",")):
            self.count += 1
            if s:
                c = s.compounds[0]
                key = ("#", c.ids[0]) if c.ids else (".", c.classes[0]) if c.classes else ("", c.tag)
                self.rules.setdefault(key, []).append((s, how, self.count))

    def of(self, node) -> dict[str, str]:
        """What the cascade makes of ``display`` and ``visibility`` for an element; nothing where no author says so."""
        best: dict[str, tuple] = {}

        def put(how: dict, place: tuple) -> None:
            for name, (value, important) in how.items():
                if name not in best or (important, *place) >= best[name][0]:
                    best[name] = (important, *place), value

        if self.rules:
            a = node.attrs
            for key in (("", ""), ("", node.tag), ("#", a.get("id", "")), *((".", c) for c in dict.fromkeys(a.get("class", "").split()))):
                for s, how, order in self.rules.get(key, ()):
                    if s.fits(node):
                        put(how, (False, s.weight, order))
        if "style" in node.attrs:
            put(declared(_COMMENT.sub(" ", node.attrs["style"])), (True, (0, 0, 0), 0))
        return {name: value for name, (_, value) in best.items() if value != "revert"}
