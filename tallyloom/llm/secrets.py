"""Secret scans: known shapes by pattern, and novel strings by dictionary-primed compression.

A candidate string on either side of a sensitive word is measured in context: zstandard is primed with the code around
the candidate and a dictionary of common identifiers, and the candidate's marginal compressed bytes tell how much of
it the context explains. Strings that stay incompressible are reported as kind ``novel``, with the candidate lines that
follow such a string directly (the lines of a key). The closer to the word, the less a candidate has to look like a secret
to be measured. Every whole text is read once, in place; there is no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.frames import arrow_map
from tallyloom.llm.textbatch import Texts

# The patterns and least lengths of the three base kinds, in the order of the report.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX_LEAST = 16
KINDS = ["assign", "access", "hex", "novel"]

#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(
    r"(?:passw|passphrase|secret|token|api[\x20_-]?key|private[\x20_-]?key|credential|bearer|authorization|auth[\x20_-]?key"
    r"|access[\x20_-]?key|client[\x20_-]?id|conn(?:ection)?[\x20_-]?str)",
    re.IGNORECASE | re.ASCII,
)
QUICK = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "authorization", "client", "conn")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~!@#$%^&*-]{12,}")
CANDIDATE_SIGN = re.compile(r"[A-Za-z0-9+/_=.~!@#$%^&*-]")
#: Identifiers and phrases of code and configuration that prime the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret credential bearer "
    "authorization username user login account config settings environment export return function class import from "
    "public static final string value default example placeholder changeme null none true false undefined localhost "
    "http://www. https:// .com .org .net /usr/local/bin /etc/ index.html content-type application/json charset=utf-8 "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx ................ "
    "your_token_here your_api_key_here get_token set_password token_type expires_in refresh_token access_token "
)

_HEX = np.zeros(256, bool)
_HEX[48:58] = True
_HEX[97:103] = True


@dataclass(frozen=True)
class Novelty:
    """Limits of the novelty measure: code points of context on each side, in which candidates lie too, how far around a
    sensitive word any mixed string is one, and the marginal compressed bits per byte from which a string is reported."""

    context: int = 240
    reach: int = 48
    bits: float = 4.0
    distinct: int = 8


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Compressed bytes that the candidate adds to its surroundings, primed with the identifiers."""
    prime = zstandard.ZstdCompressionDict((IDENTIFIERS + after + "\n" + before).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    level = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False)
    squeeze = zstandard.ZstdCompressor(dict_data=prime, compression_params=level)
    return len(squeeze.compress(candidate.encode())) - len(squeeze.compress(b""))


def _base(text: str, low: str) -> list[tuple[int, int, int]]:
    found = []
    if any(w in low for w in ("passw", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found


RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+")


def _irregular(body: str) -> bool:
    """Whether the letters of a string change case as no words joined in camel case do."""
    runs = RUNS.findall(body)
    return sum(len(r) > 1 if r[0].isupper() else len(r) == 1 and r.islower() for r in runs) >= 3


def _plausible(body: str, near: bool, limits: Novelty) -> bool:
    """Whether a candidate is worth the measure: beside the word letters with digits, or letters of irregular case;
    farther off both cases and digits."""
    if len(set(body)) < limits.distinct:
        return False
    digits, letters = any(c.isdigit() for c in body), any(c.isalpha() for c in body)
    if near:
        return letters and (digits or _irregular(body))
    return digits and any(c.isupper() for c in body) and any(c.islower() for c in body) and _irregular(body)


def _next_line(text: str, end: int) -> re.Match | None:
    """The candidate that is all of the next line, if it is."""
    start = end + 1 if text[end : end + 1] == "\n" else end + 2 if text[end : end + 2] == "\r\n" else -1
    found = CANDIDATE.match(text, start) if start >= 0 else None
    return found if found and text[found.end() : found.end() + 1] in ("", "\n", "\r") else None


def _novel(text: str, taken: list[tuple[int, int, int]], limits: Novelty) -> list[tuple[int, int, int]]:
    spans = sorted((a, b) for a, _, b in taken)
    done, out = -1, []

    def reported(a: int, b: int) -> bool:
        spent = marginal_bytes(text[a:b], text[max(0, a - limits.context) : a], text[b : b + limits.context])
        return 8 * spent >= limits.bits * len(text[a:b].encode())

    def free(a: int, b: int) -> bool:
        return a >= done and not any(x < b and a < y for x, y in spans)

    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    first = 0
    for m in _candidates(text, words, limits.context):
        a, b = m.span()
        while first < len(words) and words[first][1] + limits.context <= a:
            first += 1
        # of the words whose context holds the candidate the closest counts
        close = takewhile(lambda w: w[0] - b < limits.context, islice(words, first, None))
        gap = min((max(a - y, x - b, 0) for x, y in close), default=limits.context)
        if not free(a, b) or gap >= limits.context or not _plausible(m[0], gap < limits.reach, limits) or not reported(a, b):
            continue
        out.append((a, 3, b))
        done = b
        while (line := _next_line(text, done)) and free(*line.span()) and len(set(line[0])) >= limits.distinct and reported(*line.span()):
            out.append((line.start(), 3, line.end()))
            done = line.end()
    return out


def _candidates(text: str, words: list[tuple[int, int]], context: int):
    """Whole candidate strings that start within ``context`` around some word, in order, each once."""
    upto = 0
    for x, y in words:
        at = max(upto, x - context)
        while at and at > upto and CANDIDATE_SIGN.match(text, at - 1):
            at -= 1  # the string that the context cuts
        while (m := CANDIDATE.search(text, at)) and m.start() < y + context:
            yield m
            at = m.end()
        upto = max(upto, min(at, y + context))


def _hex_runs(texts: Texts) -> list[list[tuple[int, int]]]:
    starts, ends = texts._runs(_HEX[texts.data])
    long = ends - starts >= HEX_LEAST
    starts, ends = starts[long], ends[long]
    points = texts.chars_before()
    owner = texts.owner(starts)
    base = points[texts.offsets[:-1]]
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    for i, a, b in zip(owner.tolist(), points[starts].tolist(), points[ends].tolist()):
        out[i].append((int(a - base[i]), int(b - base[i])))
    return out


def scan_texts(texts: Texts, limits: Novelty = Novelty()) -> list[list[tuple[str, int, int]]]:
    """Per text its spans (kind, start, end) in code points, by start and then kind."""
    out = []
    for i, runs in enumerate(_hex_runs(texts)):
        raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
        low = raw.lower()
        found = [(a, 2, b) for a, b in runs]
        # folded letters beyond ASCII can't matter: the patterns hold ASCII letters only
        if b"AKIA" in raw or any(w.encode() in low for w in QUICK):
            text = raw.decode("utf-8")
            found += _base(text, text.lower())
            if any(w.encode() in low for w in QUICK):
                found += _novel(text, found, limits)
        out.append([(KINDS[k], a, b) for a, k, b in sorted(found)])
    return out


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", limits: Novelty = Novelty()) -> DataFrame:
    """One row per row of ``docs``: its id and ``found``, an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans. Repeated ids stay separate rows, other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batch: pa.RecordBatch):
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices():
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in scan_texts(texts, limits)]
            yield {id_column: batch.column(0).slice(first, end - first), "found": pa.array(rows, span)}

    return arrow_map(docs, [id_column, text], each, f"`{id_column}` {kind}, found array<struct<kind:string,start:long,end:long>>")


def redact(
    docs: DataFrame, mark: str = "[secret]", text: str = "text", n_chars: str | None = None, limits: Novelty = Novelty()
) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` in ``text``; overlapping spans become one mark. All columns
    and their order stay; rows without findings are unchanged, null texts stay null. If ``n_chars`` names a column, it
    is counted anew in rows that change."""
    schema = docs.schema
    names = schema.names
    at = names.index(text)

    def each(batch: pa.RecordBatch):
        column = batch.column(at)
        made: list[str | None] = []
        changed: list[bool] = []
        for _, _, texts in Texts.from_arrow(column).slices():
            for i, spans in enumerate(scan_texts(texts, limits)):
                body, parts, upto = texts.text(i), [], 0
                for _, a, b in spans:
                    if a >= upto:
                        parts += [body[upto:a], mark]
                    upto = max(upto, b)
                made.append("".join(parts) + body[upto:])
                changed.append(bool(spans))
        made = [x if ok else None for x, ok in zip(made, column.is_valid().to_pylist())]
        out = {n: (pa.array(made, pa.string()) if i == at else batch.column(i)) for i, n in enumerate(names)}
        if n_chars in out:
            old = out[n_chars]
            out[n_chars] = pc.if_else(pa.array(changed), pc.utf8_length(out[text]).cast(old.type), old)
        yield out

    return arrow_map(docs, names, each, schema)


def joined(kinds: list[str]):
    """Spans of these kinds as text ``kind:start:end``, comma-joined in order."""
    picked = F.filter("found", lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(picked, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def counted(kind: str):
    """How many spans of this kind a row has."""
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
