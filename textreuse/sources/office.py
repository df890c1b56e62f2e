"""Word documents of both kinds: the text of a legacy .doc, and the smallest files of each kind that hold a text.

A .doc is a compound file: a small file system of sectors, whose chains the allocation table gives. Short streams lie in
sectors of 64 bytes inside a stream of their own. The text is listed in the piece table of the table stream: each piece
lies anywhere in the main stream, in one byte or two per sign.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable
from itertools import islice
from xml.sax.saxutils import escape

# Fixed values of the two formats.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE, IS_FAT, IS_DIFAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC
IN_HEADER, CUTOFF, ENTRY = 109, 4096, 128
WORD_97 = 0xC1
FLAG_COMPLEX, FLAG_ENCRYPTED, FLAG_TABLE_1 = 0x0004, 0x0100, 0x0200
AT_FLAGS, AT_OLD_TEXT, AT_MAIN_LENGTH, AT_CLX = 0x0A, 0x18, 0x4C, 0x1A2
WORDML = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def numbers(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])


def chain(table: tuple[int, ...], start: int) -> list[int]:
    """The sectors from start on. A chain that leaves the table or meets itself is an error."""
    found, at = [], start
    while at != END:
        if at >= len(table) or len(found) > len(table):
            raise ValueError("broken chain of sectors")
        found.append(at)
        at = table[at]
    return found


def streams(content: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name; of equal names in different folders the first."""
    if content[:8] != MAGIC or len(content) < 512:
        raise ValueError("no compound file")
    shift, small_shift = struct.unpack_from("<2H", content, 30)
    if shift not in (9, 12) or small_shift >= shift:
        raise ValueError("unknown size of sectors")
    size, small = 1 << shift, 1 << small_shift
    directory_at, _, cutoff, small_fat_at, _, difat_at = struct.unpack_from("<6I", content, 48)

    def sector(i: int) -> bytes:
        found = content[(i + 1) * size : (i + 2) * size]
        if not found:
            raise ValueError("a sector lies beyond the end")
        return found.ljust(size, b"\0")

    places, seen = list(numbers(content[76:512])), set()
    while difat_at not in (END, FREE):
        if difat_at in seen:
            raise ValueError("broken chain of sectors")
        seen.add(difat_at)
        *more, difat_at = numbers(sector(difat_at))
        places += more
    table = tuple(n for i in places if i < IS_DIFAT for n in numbers(sector(i)))
    whole = lambda start: b"".join(map(sector, chain(table, start)))
    listed = whole(directory_at)
    entries = []
    for i in range(0, len(listed), ENTRY):
        e = listed[i : i + ENTRY]
        length, kind = struct.unpack_from("<HB", e, 64)
        start, n = struct.unpack_from("<II", e, 116)
        if kind in (2, 5):
            entries.append((e[: max(0, length - 2)].decode("utf-16-le", "replace"), kind, start, n))
    root = next((e for e in entries if e[1] == 5), None)
    held = whole(root[2]) if root and root[3] else b""
    small_table = numbers(whole(small_fat_at)) if small_fat_at < IS_DIFAT else ()
    found: dict[str, bytes] = {}
    for name, kind, start, n in entries:
        if kind == 2 and name not in found:
            if not n:
                raw = b""
            elif n < cutoff:
                raw = b"".join(held[i * small : (i + 1) * small] for i in chain(small_table, start))
            else:
                raw = whole(start)
            if len(raw) < n:
                raise ValueError(f"stream {name} is cut off")
            found[name] = raw[:n]
    return found


def pieces(clx: bytes) -> list[tuple[int, int, int]]:
    """(first sign, sign after the last, place as stored) of each piece."""
    at = 0
    while at < len(clx) and clx[at] == 1:  # properties of paragraphs come first
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        raise ValueError("no piece table")
    length = struct.unpack_from("<I", clx, at + 1)[0]
    plc = clx[at + 5 : at + 5 + length]
    n = (length - 4) // 12
    if n < 0 or len(plc) < length:
        raise ValueError("the piece table is cut off")
    signs = struct.unpack_from(f"<{n + 1}I", plc)
    places = [struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)[0] for i in range(n)]
    return list(zip(signs, signs[1:], places, strict=False))


def visible(text: str) -> str | None:
    """Without the instructions of fields and marks of objects; paragraphs and cells that hold anything, a blank line between."""
    out, open_fields = [], []
    for part in re.split(r"([\x13-\x15])", text):
        if part == "\x13":
            open_fields.append(True)  # its instruction comes first
        elif part == "\x14" and open_fields:
            open_fields[-1] = False
        elif part == "\x15" and open_fields:
            open_fields.pop()
        elif not any(open_fields):
            out.append(part)
    shown = "".join(out).replace("\x0b", "\n").replace("\x1e", "-")
    paragraphs = (re.sub(r"[\x00-\x08\x0e-\x1f]", "", p) for p in re.split(r"[\r\x07\x0c]", shown))
    return "\n\n".join(p for p in paragraphs if p.strip()) or None


def doc_text(content: bytes) -> str | None:
    """The main text of a .doc, also of one that is a .docx by content. Encrypted and broken files raise ValueError."""
    if content[:2] == b"PK":
        from textreuse.sources.files import docx_text

        return docx_text(content)
    found = streams(content)
    main = found.get("WordDocument", b"")
    if len(main) < AT_MAIN_LENGTH + 4 or main[:1] != b"\xec":
        raise ValueError("no Word document")
    version, flags = struct.unpack_from("<H", main, 2)[0], struct.unpack_from("<H", main, AT_FLAGS)[0]
    if flags & FLAG_ENCRYPTED:
        raise ValueError("encrypted")
    if version < WORD_97:
        if flags & FLAG_COMPLEX:
            raise ValueError("an old document that was saved in pieces")
        a, z = struct.unpack_from("<2I", main, AT_OLD_TEXT)
        return visible(main[a:z].decode("cp1252", "ignore"))
    if len(main) < AT_CLX + 8:
        raise ValueError("no Word document")
    table = found.get("1Table" if flags & FLAG_TABLE_1 else "0Table", b"")
    length = struct.unpack_from("<I", main, AT_MAIN_LENGTH)[0]
    a, n = struct.unpack_from("<2I", main, AT_CLX)
    units = []
    for first, after, place in pieces(table[a : a + n]):
        after = min(after, length)  # what follows is notes and headers
        if after <= first:
            continue
        single, offset, count = place >> 30 & 1, place & 0x3FFFFFFF, after - first
        raw = main[offset // 2 : offset // 2 + count] if single else main[offset : offset + 2 * count]
        if len(raw) < (count if single else 2 * count):
            raise ValueError("a piece lies beyond the end")
        units.append(raw.decode("cp1252", "replace").encode("utf-16-le") if single else raw)
    return visible(b"".join(units).decode("utf-16-le", "replace"))


def paragraphs_of(text: str) -> list[str]:
    """Lines without the signs that neither format can hold."""
    return re.sub(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", "", text).split("\n")


def docx_file(text: str) -> bytes:
    """The smallest .docx with a paragraph per line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs_of(text))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORDML}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def doc_file(text: str, piece: int = 1 << 16, notes: str = "", placed: Callable[[list[int]], None] | None = None) -> bytes:
    """The smallest .doc with a paragraph per line, in pieces of that many signs, each in one byte per sign where it can be."""
    main_text = "\r".join(paragraphs_of(text))
    units = (main_text + notes).encode("utf-16-le")
    body, signs, places = b"", [0], []
    for i in range(0, len(units), 2 * piece):
        raw = units[i : i + 2 * piece]
        try:
            raw, single = raw.decode("utf-16-le").encode("cp1252"), True
        except UnicodeError:
            single = False
        body += b"\0" * (len(body) % 2)
        places.append((1024 + len(body)) * 2 | 1 << 30 if single else 1024 + len(body))
        body += raw
        signs.append(signs[-1] + min(piece, (len(units) - i) // 2))
    plc = struct.pack(f"<{len(signs)}I", *signs) + b"".join(struct.pack("<HIH", 0, p, 0) for p in places)
    clx = b"\x01" + struct.pack("<H", 2) + b"\0\0" + b"\x02" + struct.pack("<I", len(plc)) + plc
    head = bytearray(1024)
    struct.pack_into("<HH", head, 0, 0xA5EC, WORD_97)
    struct.pack_into("<H", head, AT_FLAGS, FLAG_TABLE_1)
    for at, n in ((0x20, 14), (0x3E, 22), (0x98, 93)):
        struct.pack_into("<H", head, at, n)
    struct.pack_into("<I", head, AT_MAIN_LENGTH, len(main_text.encode("utf-16-le")) // 2)
    struct.pack_into("<2I", head, AT_CLX, 0, len(clx))
    return compound_file({"1Table": clx, "WordDocument": bytes(head) + body}, placed)


def compound_file(held: dict[str, bytes], placed: Callable[[list[int]], None] | None = None) -> bytes:
    """A compound file of these streams. placed may put its list of sector numbers into another order."""
    small, small_table, where = b"", [], {}
    for name, raw in held.items():
        if raw and len(raw) < CUTOFF:
            where[name], n = len(small_table), -(-len(raw) // 64)
            small_table += [*range(len(small_table) + 1, len(small_table) + n), END]
            small += raw.ljust(64 * n, b"\0")
    parts = {0: small, 1: struct.pack(f"<{len(small_table)}I", *small_table), 2: b"\0" * ENTRY * (len(held) + 1)}
    parts |= {k: raw for k, raw in held.items() if len(raw) >= CUTOFF}
    need = {k: -(-len(raw) // 512) for k, raw in parts.items()}
    fats = difats = 0
    while (total := sum(need.values()) + fats + difats) > 128 * fats or fats > IN_HEADER + 127 * difats:
        fats = max(fats, -(-total // 128))
        difats = max(0, -(-(fats - IN_HEADER) // 127))
    free = list(range(total))
    if placed is not None:
        placed(free)
    table, sectors = [FREE] * (128 * fats), [b""] * total
    left = iter(free)
    take = lambda n: list(islice(left, n))
    chains = {k: take(n) for k, n in need.items()}
    fat, difat = take(fats), take(difats)
    for c in chains.values():
        for a, b in zip(c, [*c[1:], END], strict=False):  # an empty chain gives none
            table[a] = b
    for i in fat:
        table[i] = IS_FAT
    for i in difat:
        table[i] = IS_DIFAT
    first = {k: c[0] if c else END for k, c in chains.items()}
    # names in the order of the format, each the right neighbour of the one before
    names = sorted(held, key=lambda k: (len(k), k.upper()))
    entries = [("Root Entry", 5, FREE, 1 if names else FREE, first[0], len(small))]
    entries += [(k, 2, i + 2 if i + 1 < len(names) else FREE, FREE, first.get(k, where.get(k, END)), len(held[k])) for i, k in enumerate(names)]
    parts[2] = b""
    for name, kind, right, child, start, n in entries:
        raw = name.encode("utf-16-le") + b"\0\0"
        parts[2] += raw.ljust(64, b"\0") + struct.pack("<HBB3I36xIQ", len(raw), kind, 1, FREE, right, child, start, n)
    for k, c in chains.items():
        for j, i in enumerate(c):
            sectors[i] = parts[k][512 * j : 512 * (j + 1)].ljust(512, b"\0")
    for j, i in enumerate(fat):
        sectors[i] = struct.pack("<128I", *table[128 * j : 128 * (j + 1)])
    rest = fat[IN_HEADER:]
    for j, i in enumerate(difat):
        here = rest[127 * j : 127 * (j + 1)]
        sectors[i] = struct.pack("<128I", *here, *[FREE] * (127 - len(here)), difat[j + 1] if j + 1 < difats else END)
    head = MAGIC + b"\0" * 16 + struct.pack("<5H6x", 0x3E, 3, 0xFFFE, 9, 6)
    head += struct.pack("<9I", 0, fats, first[2], 0, CUTOFF, first[1], need[1], difat[0] if difat else END, difats)
    head += struct.pack(f"<{IN_HEADER}I", *(fat[:IN_HEADER] + [FREE] * max(0, IN_HEADER - fats)))
    return head + b"".join(sectors)
