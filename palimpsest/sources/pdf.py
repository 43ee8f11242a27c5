"""A small PDF reader: Flate or plain content streams, simple fonts with /Widths, text-show operators with state.

What lies beyond (encryption, object streams, composite or unknown fonts) is reported as not safe and stays scan-only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from palimpsest.sources.opc import _map

ITEMS_SCHEMA = "source string, page int, idx int, op string, text string, safe boolean, advance double, can_clean boolean"
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*][A-Za-z0-9*]*", re.S)
OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
PROTECTED = re.compile(rb"/Encrypt\b|/Type\s*/Sig\b|/FT\s*/Sig\b|/Perms\b|msip_label_|mip_label_", re.I)


def unescape(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r\n") else ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def objects(raw: bytes) -> dict[int, bytes]:
    return {int(m[1]): m[2] for m in OBJECT.finditer(raw)}


def stream_of(body: bytes) -> bytes | None:
    m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S)
    if not m:
        return None
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return None
    return None if b"/Filter" in body[: m.start()] else m[1]


def refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def fonts_of(page: bytes, objs: dict[int, bytes]) -> dict[str, tuple[int, list[float]] | None]:
    """Name to (first char, widths); null where widths are not given."""
    found = {}
    holder = page
    for r in refs(page, rb"/Resources"):
        holder += objs.get(r, b"")
    for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", holder):
        font = objs.get(int(ref), b"")
        if b"/Font" not in font:
            continue
        widths = re.search(rb"/Widths\s*\[([^\]]*)\]", font)
        first = re.search(rb"/FirstChar\s+(\d+)", font)
        simple = re.search(rb"/Subtype\s*/(Type1|TrueType)\b", font) and b"/Differences" not in font
        found[name.decode("latin1")] = (int(first[1]), [float(x) for x in widths[1].split()]) if widths and first and simple else None
    return found


def text_items(content: bytes, fonts: dict[str, tuple[int, list[float]] | None]) -> Iterator[tuple[int, str, str, bool, float]]:
    """(idx, op, text, safe, advance): advance in thousandths of text space, negative as in a TJ array."""
    state, stack, args, idx = {"font": None, "size": 0.0, "tc": 0.0, "tw": 0.0}, [], [], 0
    for token in TOKEN.findall(content):
        if not re.fullmatch(rb"[A-Za-z'\"*][A-Za-z0-9*]*", token):
            args.append(token)
            continue
        op = token.decode("latin1")
        if op == "q":
            stack.append(dict(state))
        elif op == "Q":
            state = stack.pop() if stack else state
        elif op == "Tf" and len(args) >= 2:
            state |= {"font": args[-2][1:].decode("latin1"), "size": float(args[-1])}
        elif op in ("Tc", "Tw") and args:
            state[op.lower()] = float(args[-1])
        elif op in ("Tj", "TJ", "'", '"'):
            if op == '"' and len(args) >= 3:
                state |= {"tw": float(args[-3]), "tc": float(args[-2])}
            parts = [a for a in args if a not in (b"[", b"]")] if op == "TJ" else args[-1:]
            font, text, advance = fonts.get(state["font"] or ""), [], 0.0
            safe = font is not None and state["size"] != 0
            for p in parts:
                if p[:1] not in b"(<":
                    advance += float(p)
                    continue
                raw = unescape(p)
                text.append(raw.decode("cp1252", "replace"))
                if safe:
                    places = [c - font[0] for c in raw]
                    safe = all(0 <= k < len(font[1]) for k in places)
                    if safe:
                        advance -= sum(font[1][k] for k in places) + (len(raw) * state["tc"] + raw.count(b" ") * state["tw"]) * 1000 / state["size"]
            yield idx, op, "".join(text), safe, advance
        args = []
        idx += 1


def text_of(token: bytes) -> str:
    """A string object as text: UTF-16 with its mark, else one byte a character."""
    raw = unescape(token)
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace")


def pages_of(objs: dict[int, bytes]) -> list[bytes]:
    """Page objects in the order of their numbers."""
    return [b for _, b in sorted(objs.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]


def page_items(page: bytes, objs: dict[int, bytes]) -> Iterator[tuple[int, str, str, bool, float]]:
    streams = [stream_of(objs.get(r, b"")) for r in refs(page, rb"/Contents")]
    return text_items(b"\n".join(s for s in streams if s), fonts_of(page, objs))


def strings_of(body: bytes, keys: str) -> list[tuple[str, bytes, int, int]]:
    """(key, token, begin, end) of the string values of a dictionary's ``keys`` (a pattern)."""
    return [(m[1].decode("latin1"), m[2], m.start(2), m.end(2)) for m in re.finditer(rb"/(%s)\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)" % keys.encode(), body, re.S)]


def info_number(raw: bytes) -> int | None:
    found = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", raw)
    return int(found[-1]) if found else None


def properties_of(raw: bytes, objs: dict[int, bytes]) -> dict[str, str]:
    return {k: text_of(t) for k, t, _, _ in strings_of(objs.get(info_number(raw) or -1, b""), r"[A-Za-z0-9_.\-]+")}


def annotations_of(page: bytes, objs: dict[int, bytes]) -> Iterator[tuple[int, str, str]]:
    """(place, key, text) of a page's annotations: contents, title and subject."""
    listed = re.search(rb"/Annots\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", page)
    if listed is None:
        return
    whole = listed[1] if listed[1] is not None else objs.get(int(listed[2]), b"")
    for j, number in enumerate(re.findall(rb"(\d+)\s+\d+\s+R", whole)):
        for key, token, _, _ in strings_of(objs.get(int(number), b""), "Contents|T|Subj"):
            yield j, key, text_of(token)


def xmp_of(objs: dict[int, bytes]) -> list[str]:
    bodies = [b for b in objs.values() if re.search(rb"/Type\s*/Metadata\b", b)]
    return [(stream_of(b) or b"").decode("utf-8", "replace") for b in bodies]


def protected(raw: bytes, objs: dict[int, bytes]) -> bool:
    """Encrypted, signed or labelled: scanned, never changed."""
    labels = any(re.search("msip_label_|mip_label_|sensitivity", x, re.I) for x in xmp_of(objs))
    return bool(PROTECTED.search(raw)) or labels or any("msip_label_" in k.lower() for k in properties_of(raw, objs))


def boxes_of(objs: dict[int, bytes]) -> list[tuple[bytes, ...]]:
    """Sizes and turns of the pages: what cleaning must not change, nor their number."""
    return [tuple(m[0] if (m := re.search(rb"/%s\s*(?:\[[^\]]*\]|-?\d+)" % k, p)) else b"" for k in (b"MediaBox", b"CropBox", b"Rotate")) for p in pages_of(objs)]


def clean_properties(raw: bytes, pattern: re.Pattern, keys: set[str]) -> bytes:
    """The file with keywords gone from those properties."""
    objs, number = objects(raw), info_number(raw)
    if protected(raw, objs):
        raise ValueError("protected, signed or encrypted")
    body = objs.get(number or -1, b"")
    for key, token, begin, end in reversed(strings_of(body, r"[A-Za-z0-9_.\-]+")):
        if key in keys:
            new = pattern.sub("", text_of(token))
            body = body[:begin] + b"<" + (b"\xfe\xff" + new.encode("utf-16-be")).hex().encode() + b">" + body[end:]
    if number is not None:
        objs[number] = body
    return assembled(objs, raw)


def items_of(documents: DataFrame) -> DataFrame:
    """ITEMS_SCHEMA from source, content."""

    def make(source: str, content: bytes) -> Iterator[tuple]:
        objs = objects(content)
        can_clean = not PROTECTED.search(content)
        pages = [b for _, b in sorted(objs.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]
        for n, page in enumerate(pages, 1):
            streams = [stream_of(objs.get(r, b"")) for r in refs(page, rb"/Contents")]
            for idx, op, text, safe, advance in text_items(b"\n".join(s for s in streams if s), fonts_of(page, objs)):
                yield source, n, idx, op, text, safe, advance, can_clean

    return _map(documents.select("source", "content"), ITEMS_SCHEMA, make)


def show_spans(content: bytes) -> Iterator[tuple[int, int, int, str, list[bytes]]]:
    """(idx, begin, end, op, operands) of the operators, with their places in the stream."""
    args, begin, idx = [], None, 0
    for m in TOKEN.finditer(content):
        if begin is None:
            begin = m.start()
        if re.fullmatch(rb"[A-Za-z'\"*][A-Za-z0-9*]*", m[0]):
            yield idx, begin, m.end(), m[0].decode("latin1"), args
            args, begin, idx = [], None, idx + 1
        else:
            args.append(m[0])


def clean(raw: bytes, pattern: re.Pattern, selected: set[tuple[int, int]] | None = None) -> bytes:
    """The file with the matching text-show operators (of ``selected`` page and idx, or all) replaced, whole, by a TJ of
    the same advance, so that nothing else moves. Unsafe operators are refused; what is kept is read back and compared.

    The objects are written anew with a cross-reference table; older revisions of the file do not survive."""
    if PROTECTED.search(raw):
        raise ValueError("protected, signed or encrypted")
    objs = objects(raw)
    pages = [(i, b) for i, b in sorted(objs.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    for n, (_, page) in enumerate(pages, 1):
        fonts, places = fonts_of(page, objs), refs(page, rb"/Contents")
        content = b"\n".join(stream_of(objs[r]) or b"" for r in places)
        items = {i: (op, text, safe, advance) for i, op, text, safe, advance in text_items(content, fonts)}
        out, at = [], 0
        for idx, begin, end, op, args in show_spans(content):
            if idx not in items or not pattern.search(items[idx][1]) or (selected is not None and (n, idx) not in selected):
                continue
            if not items[idx][2]:
                raise ValueError("a text block that is not safe to remove")
            lead = (b"%s Tw %s Tc T* " % (args[-3], args[-2])) if op == '"' else b"T* " if op == "'" else b""
            out += [content[at:begin], lead, b"[%.6f] TJ" % items[idx][3]]
            at = end
        if not out:
            continue
        packed = zlib.compress(b"".join(out) + content[at:])
        objs[places[0]] = b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream " % (len(packed), packed)
        for r in places[1:]:
            objs[r] = b"<</Length 0>>stream\n\nendstream "
        kept = [x[1] for i, x in sorted(items.items()) if x[1] and not (pattern.search(x[1]) and (selected is None or (n, i) in selected))]
        if kept != [x[2] for x in text_items(stream_of(objs[places[0]]) or b"", fonts) if x[2]]:
            raise ValueError("kept text would change")
    return assembled(objs, raw)


def assembled(objs: dict[int, bytes], raw: bytes) -> bytes:
    trailer = b"".join(re.findall(rb"/(?:Root|Info)\s+\d+\s+\d+\s+R", raw[raw.rfind(b"trailer") :]))
    out, places = [raw[: raw.find(b"\n") + 1]], {}
    at = len(out[0])
    for i, body in sorted(objs.items()):
        one = b"%d 0 obj%s endobj\n" % (i, body)
        places[i] = at
        out.append(one)
        at += len(one)
    size = max(objs, default=0) + 1
    rows = b"".join(b"%010d 00000 n \n" % places[i] if i in places else b"0000000000 65535 f \n" for i in range(size))
    return b"".join(out) + b"xref\n0 %d\n%strailer<</Size %d%s>>\nstartxref\n%d\n%%%%EOF\n" % (size, rows, size, trailer, at)
