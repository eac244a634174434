"""Periodic runs of words: maximal repetitions of every text, and the text without its repeated periods.

A stretch with period p and at least max(LEAST, 2 p) words holds at least g = max(p, LEAST - p) places in a row whose words
equal the words p later. So one of the places g - 1, 2 g - 1, 3 g - 1, ... is such a place: the grid of period p, some
n / p places, n log n over all periods. Where a grid place has equal words, extensions in both directions, taken from
the recompression grammar of the texts, give the whole stretch. One stretch found with several periods has the least of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.frames import arrow_map
from tallyloom.llm.grammar import Grammar
from tallyloom.llm.textbatch import Texts

#: Words that a run has at least.
LEAST = 12
#: Grid places that are looked at together; bounds the working arrays whatever the length of a text.
TOGETHER = 1 << 20


def _grid(begins: np.ndarray, sizes: np.ndarray, least: int):
    """Yields (place, period) arrays of all grid places of all texts."""
    most = np.where(sizes >= least, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    gap = np.maximum(period, least - period)
    many = (sizes[text] - period) // gap
    upto = np.cumsum(many)
    first = 0
    while first < len(text):
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + TOGETHER, "right")))
        some = many[first:end]
        step = np.repeat(gap[first:end], some)
        k = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        yield np.repeat(begins[text[first:end]], some) + step * (k + 1) - 1, np.repeat(period[first:end], some)
        first = end


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of several texts as (text, start, length, period), by text, start and period.

    ``words`` has a number for each word (equal words, equal numbers), text after text; ``sizes`` the words per text.
    """
    texts = len(sizes)
    ends = np.cumsum(sizes)
    # a mark before every text and one at the very end
    sequence = np.insert(np.asarray(words, np.int64) + texts + 1, np.append(ends - sizes, ends[-1] if texts else 0), np.arange(texts + 1))
    begins = ends - sizes + np.arange(1, texts + 1)
    grammar = None
    rows = [np.zeros((3, 0), np.int64)]
    for place, period in _grid(begins, np.asarray(sizes), least):
        hit = sequence[place] == sequence[place + period]
        place, period = place[hit], period[hit]
        if not len(place):
            continue
        grammar = grammar or Grammar(sequence, texts + 1)
        behind = grammar.extend(place, place + period, False)
        before = grammar.extend(place, place + period, True)
        start, length = place - before, before + behind + period
        long = length >= np.maximum(least, 2 * period)
        rows.append(np.unique(np.stack([start[long], length[long], period[long]]), axis=1))
    start, length, period = np.concatenate(rows, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least_period = np.ones(len(start), bool)
    least_period[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least_period], length[least_period], period[least_period]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(begins, start, "right") - 1
    return text, start - begins[text] if len(text) else start, length, period


def _joined(texts: Texts, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The given words of each text, joined by one blank; ``counts`` has the words per text."""
    sizes = ends - starts + 1
    upto = np.cumsum(sizes)
    out = np.full(int(upto[-1]) if len(upto) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[upto - 1] = False
    out[inside] = texts.data[(np.repeat(starts - (upto - sizes), sizes) + np.arange(len(out)))[inside]]
    data = out.tobytes()
    cuts = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [data[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:])]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: id, runs (array of start, length, period by start, then period) and collapsed, the words
    outside all runs and those in the first period of every run that holds them, joined by one blank.

    A run is a stretch of consecutive words with smallest period q and at least max(least, 2 q) words that no neighbouring word
    extends keeping the period. Null, empty and wordless texts have no runs and an empty collapsed text. Repeated
    ids stay separate rows, null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices():
            starts, ends = texts.words()
            cuts = np.searchsorted(starts, texts.offsets)
            sizes = np.diff(cuts)
            _, words = np.unique(texts.hashes(starts, ends), return_inverse=True)
            of, start, length, period = find_runs(words, sizes, least)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, cuts[of] + start + period, 1)
            np.add.at(change, cuts[of] + start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            counts = np.diff(np.concatenate(([0], np.cumsum(kept)))[cuts])
            collapsed = _joined(texts, starts[kept], ends[kept], counts)
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            yield {
                id_column: batch.column(0).slice(first, end - first),
                "runs": pa.ListArray.from_arrays(np.searchsorted(of, np.arange(end - first + 1)).astype(np.int32), runs),
                "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
            }

    schema = f"`{id_column}` {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return arrow_map(docs, [id_column, text], each, schema)
