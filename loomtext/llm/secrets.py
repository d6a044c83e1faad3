"""Secret scan with a recursive decoding worklist.

A text is layer 0. Runs that look URL-encoded, Unicode-escaped or like base64 are decoded into new
layers, and so are gzip and zlib data in a decoded layer; every new layer is scanned and
put on the worklist itself, until nothing new appears. A layer whose content was seen before in the
same text is not decoded again, which ends cycles. Secrets of a decoded layer are reported with the
spans of all outermost encoded runs in the original text that lead to it; in an escaped run, which
takes in the plain text around its escapes, that is the part of it that decodes to the find.

A decoded layer that is not valid UTF-8 is scanned with one character for each byte. An inflated layer
of over ``max_inflated`` bytes is inflated as a stream and scanned in overlapping windows (counted in
``n_oversize``). Fixed limits there keep a hostile text from growing without end: a run of over 16
times ``max_inflated`` is decoded in pieces, and streams within streams are inflated 20 deep.

Base64 is read from each of the first four characters of its run, since a path or another word may
stand directly before it, and lines of one wrapped stretch are read together.

Defined cases: null text counts as empty; repeated rows give equal results; very long texts are read
whole, in time linear in their length for each layer; where several codings lead to one find, the
way of least depth is told, then the first by name; an empty table gives no rows; null ids stay null;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import heapq
import re
import zlib
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import ship_package

# Fixed values of the base kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Any keyword of ASSIGN begins with one of these; texts without them skip it.
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: A run starts where no character of its class stands before it, and gives nothing back: linear in any text.
URL_RUN = re.compile(r"(?<![A-Za-z0-9._~+/=:&?-])[A-Za-z0-9._~+/=:&?-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9._~+/=:&?-]*+)++")
#: Whole stretches of escapes and the printable text around them; those without an escape are no runs.
UNICODE_RUN = re.compile(r"(?:[\x20-\x5b\x5d-\x7e]+|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
#: The shortest secret has 12 characters, so 16 in base64: shorter runs hide none.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Base64 in lines of 40 or more.
WRAPPED_RUN = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}+\r?\n)++[A-Za-z0-9+/]++={0,2}")
#: First bytes of gzip and of zlib data without a dictionary.
HEADS = re.compile(b"|".join([rb"\x1f\x8b\x08", *(re.escape(bytes((c, f))) for c in range(0x08, 0x80, 0x10) for f in range(256) if (c * 256 + f) % 31 == 0 and not f & 0x20)]))
#: What ends every run of an encoding.
RUN_END = re.compile(rb"[^A-Za-z0-9._~+/=:&?%\\-]")
CHUNK, GROWTH, LEVELS = 1 << 16, 16, 20
#: Two halves of a pair, any other \\u escape, or \\x.
ESCAPE = re.compile(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base matches of one layer, sorted."""
    found = []
    if KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]  # a run of 24 or more is a whole run: nothing of its class can stand before it
    found.sort()
    return found


def _text(raw: bytes) -> str:
    """The bytes as UTF-8, or one character for each byte where they aren't such: all patterns are ASCII."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _slices(raw: bytes, at: int):
    return (raw[i : i + CHUNK] for i in range(at, len(raw), CHUNK))


def _inflated(chunks):
    """The data of gzip (all members) or zlib bytes in chunks, as far as they are such."""
    unpack = zlib.decompressobj(47)
    for data in chunks:
        more = True
        while data or more:
            try:
                got = unpack.decompress(data, CHUNK)
            except zlib.error:
                return
            if got:
                yield got
            data, more = unpack.unconsumed_tail, len(got) == CHUNK
            if unpack.eof:
                data, more = unpack.unused_data, False
                if data and data[:2] != b"\x1f\x8b":
                    return
                unpack = zlib.decompressobj(47)


def _windows(source, limit: int, level: int = 0):
    """The texts of a stream of bytes, source(): all of it up to limit bytes; beyond, a None and overlapping windows.

    Half of limit comes again in the next window, and a window that ends in a longer run grows with it, up to GROWTH
    times limit. A stream beyond limit that is compressed itself is inflated as a stream, too, at most LEVELS deep.
    """
    chunks = source()
    buffer = bytearray()
    ended, large, packed, size = False, False, False, limit + 1
    while not ended:
        while len(buffer) < size and not ended:
            more = next(chunks, None)
            if more is None:
                ended = True
            else:
                buffer += more
        if not large and len(buffer) > limit:
            large, packed = True, HEADS.match(buffer) is not None
            yield None
        if not ended and len(buffer) < GROWTH * limit and not RUN_END.search(buffer, len(buffer) - limit // 2):
            size = len(buffer) + limit
            continue
        if buffer:
            yield _text(bytes(buffer))
        del buffer[: max(len(buffer) - limit // 2, 0)]
        size = limit + 1
    if packed and level < LEVELS:
        yield from _windows(lambda: _inflated(source()), limit, level + 1)


def _escaped(e: re.Match) -> str:
    if e[1]:
        return chr(0x10000 + (int(e[1], 16) - 0xD800 << 10) + int(e[2], 16) - 0xDC00)
    code = int(e[3] or e[4], 16)
    return "\ufffd" if 0xD800 <= code < 0xE000 else chr(code)


def _sources(run: str) -> list[int]:
    """The place in the run of each character of its unescaped text, and the end of the run."""
    out, at = [], 0
    for e in ESCAPE.finditer(run):
        out += range(at, e.start() + 1)
        at = e.end()
    return [*out, *range(at, len(run) + 1)]


#: Bytes that look like text: data that starts where the run does.
PLAIN = re.compile(rb"[\x09\x0a\x0d\x20-\x7e]*")


def _unpacked(body: str) -> bytes:
    """The bytes of base64 without its filling; a last character that says nothing is left out."""
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def decoded_runs(text: str, limit: int, inside: bool = False):
    """(start, end, name of the coding, decoded text) of the encoded runs of one layer; before the windows of one past the limit, the text is None. inside: a decoded layer, which may hold compressed bytes."""
    if "%" in text:
        for m in URL_RUN.finditer(text):
            got = _text(unquote_to_bytes(m[0]))
            if got != m[0]:
                yield m.start(), m.end(), "url", got
    if "\\u" in text or "\\x" in text:
        for m in UNICODE_RUN.finditer(text):
            if "\\" in m[0]:
                yield m.start(), m.end(), "unicode", ESCAPE.sub(_escaped, m[0])
    runs = [(m.start(), m.end(), m[0]) for m in BASE64_RUN.finditer(text)]
    if "\n" in text:
        runs += [(m.start(), m.end(), m[0].replace("\r", "").replace("\n", "")) for m in WRAPPED_RUN.finditer(text)]
    for a, b, run in runs:
        body = run.rstrip("=").replace("-", "+").replace("_", "/")
        for phase in range(4):  # what stands before the data, such as a path, may have any length
            raw = _unpacked(body[phase:])
            if raw:
                yield a, b, "base64", _text(raw)
                if not phase and PLAIN.fullmatch(raw):
                    break
    if inside:
        raw = text.encode("latin-1", "replace")
        for m in HEADS.finditer(raw):
            for got in _windows(lambda at=m.start(): _inflated(_slices(raw, at)), limit):
                yield m.start(), len(text), "compressed", got


def _key(text: str):
    """What a layer is known by: large ones aren't kept."""
    return text if len(text) <= 4096 else hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def scan(text: str, max_inflated: int = 1 << 20) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, int]], int]:
    """Base spans; (start, end, path of codings, depth) of the outermost runs that hide secrets; inflated layers past the limit, which are scanned in windows."""
    base = base_spans(text)
    oversize = 0
    number = {_key(text): 0}  # of each layer; a layer is decoded once
    runs: list[list[tuple[int, int, str, int]]] = [[]]  # the encoded runs of each layer
    queue = [(0, 0, 0)] if base else []  # depth, steps and layer, for the layers with base spans
    work = [(0, decoded_runs(text, max_inflated))]
    while work:
        layer, found = work[-1]
        for a, b, how, inner in found:
            if inner is None:
                oversize += 1
                continue
            new = len(runs)
            x = number.setdefault(_key(inner), new)
            runs[layer].append((a, b, how, x))
            if x == new:
                runs.append([])
                if base_spans(inner):
                    queue.append((0, 0, x))
                work.append((x, decoded_runs(inner, max_inflated, True)))
                break
        else:
            work.pop()
    if len(runs) == 1 or not queue:
        return base, [], oversize
    onto: dict[int, list[tuple[int, str]]] = {}
    for layer, found in enumerate(runs):
        for _, _, how, x in found:
            onto.setdefault(x, []).append((layer, how))
    near: dict[int, tuple[int, int]] = {}  # depth and steps from a layer to its nearest secret; inflating a run's bytes is no depth of its own
    onward: dict[int, tuple[str, int]] = {}
    best = {x: (0, 0) for _, _, x in queue}
    heapq.heapify(queue)
    while queue:
        depth, steps, x = heapq.heappop(queue)
        if x in near:
            continue
        near[x] = (depth, steps)
        for outer, how in onto.get(x, ()):
            far = (depth + (how != "compressed"), steps + 1)
            if outer not in best or far < best[outer]:
                best[outer], onward[outer] = far, (how, x)
                heapq.heappush(queue, (*far, outer))
    hidden: dict[tuple[int, int], tuple[int, str]] = {}

    def hides(a: int, b: int, way: str, depth: int, x: int):
        depth += near[x][0]
        while near[x][1]:
            how, x = onward[x]
            way += f">{how}"
        hidden[a, b] = min(hidden.get((a, b), (depth, way)), (depth, way))

    for a, b, how, x in runs[0]:
        if x not in near:
            continue
        if how != "unicode":
            hides(a, b, how, 1, x)
            continue
        # an escaped run takes in plain text: only its parts that hide a secret count, each with its own span
        at = _sources(text[a:b])
        for s, _, e in base_spans(ESCAPE.sub(_escaped, text[a:b])):
            if at[e] - at[s] > e - s:
                hidden[a + at[s], a + at[e]] = (1, how)
        for s, e, second, y in runs[x]:
            if y in near and at[e] - at[s] > e - s:
                hides(a + at[s], a + at[e], f"{how}>{second}", 1 + (second != "compressed"), y)
    return base, [(a, b, way, depth) for (a, b), (depth, way) in sorted(hidden.items())], oversize


def redact(text: str, max_inflated: int = 1 << 20) -> str:
    """The text with every base and hidden span replaced by [SECRET]; overlapping spans become one."""
    base, hidden, _ = scan(text, max_inflated)
    out, at = [], 0
    for a, b in sorted([(s, e) for s, _, e in base] + [(a, b) for a, b, _, _ in hidden]):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FIELDS = "doc_id long, n_assign long, n_access long, n_hex long, n_decoded long, n_oversize long, max_depth int, base_sha256 string, spans string"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_inflated: int = 1 << 20) -> DataFrame:
    """One row for each of docs: counts of the base kinds, of decoded finds and of inflated layers past the limit, the digest of the base spans, and all spans (decoded ones under the kind decoded)."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                base, hidden, oversize = scan(t.as_py() or "", max_inflated)
                counts = [0, 0, 0]
                for _, k, _ in base:
                    counts[k] += 1
                own = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                if hidden:
                    every = sorted([(a, k, b) for a, k, b in base] + [(a, 3, b) for a, b, _, _ in hidden])
                    all_spans = ",".join(f"{(*KINDS, 'decoded')[k]}:{a}:{b}" for a, k, b in every)
                else:
                    all_spans = own
                rows.append((i.as_py(), *counts, len(hidden), oversize, max((d for _, _, _, d in hidden), default=0), hashlib.sha256(own.encode()).hexdigest(), all_spans))
            types = [pa.int64()] * 6 + [pa.int32(), pa.string(), pa.string()]
            names = [f.split()[0] for f in FIELDS.split(", ")]
            cols = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, FIELDS)
