"""Benchmark passages in training texts, found by an FM-index of each training shard.

Words are runs of lower-cased ASCII letters, digits and all non-ASCII characters. A phrase is a window
of consecutive words of a benchmark item (an item with fewer words is one phrase). A shard is a bounded
slice of a partition: its texts become sequences of word numbers, in which words of no benchmark item
and text ends separate runs; each distinct run long enough for a phrase enters the index once. The
index is the Burrows-Wheeler transform of the runs in a wavelet tree. All phrases are searched backward
together, occurrences are located through sampled suffix positions and carried to every copy of their
run, and overlapping spans merge. The benchmark itself passes in blocks read from the shared folder, so
neither it nor the corpus is held whole anywhere.

Defined cases: null and empty texts have no words; an item without words occurs nowhere; items of one
item_id count as one; an item without item_id marks words but is not listed. Equal rows are judged alike.
Empty tables give no rows, or no hits. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import shared_files
from .common import small_batches, text_batches

WINDOW = 10
#: Words of benchmark items searched at once, and bytes of text in a shard.
BLOCK_WORDS, SHARD_BYTES = 300_000, 6_000_000
SAMPLE_EVERY = 8
#: Lower-cases A-Z and turns ASCII characters outside words into spaces.
FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
FOUND = "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"

_blocks: dict[tuple, list] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Phrases:
    """Distinct windows of a block of items as rows of word numbers; 0 pads short ones in front."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        import numpy as np

        self.numbers: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item_id, words in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words]
            for at in range(max(1, len(own) - window + 1)):
                found.setdefault(tuple(own[at : at + window]), set()).add(item_id)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.rows[k, window - len(p) :] = p
        self.items = [sorted(x for x in ids if x is not None) for ids in found.values()]


class FMIndex:
    """Backward search over a sequence of numbers from 1 up to ``top``; 0 is its added end."""

    def __init__(self, sequence, top: int):
        import numpy as np

        text = np.append(sequence, 0).astype(np.int64)
        n = len(text)
        order = self._suffixes(text)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros, level = [], [], last
        for bit in range(self.bits - 1, -1, -1):
            high = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(high, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[high == 0], level[high == 1]])
        self.last, self.n = last.astype(np.int32), n
        self.is_sample = order % SAMPLE_EVERY == 0
        self.sample_rank = np.cumsum(self.is_sample) - 1
        self.samples = order[self.is_sample]

    @staticmethod
    def _suffixes(text):
        """Suffix order by doubling the compared length until no two ranks are equal."""
        import numpy as np

        n, step = len(text), 1
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            step *= 2

    def rank(self, number, place):
        """How often ``number`` stands among the first ``place`` of the transform, for arrays of both."""
        import numpy as np

        start, place = np.zeros(len(place), np.int64), place.astype(np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            high = ((number >> bit) & 1).astype(bool)
            a, b = ones[start], ones[place]
            start, place = np.where(high, zeros + a, start - a), np.where(high, zeros + b, place - b)
        return place - start

    def search(self, rows):
        """(row, lo, hi) of the rows that occur, searched from their last number on; 0 stands in front of short ones."""
        import numpy as np

        at = np.arange(len(rows))
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for k in range(rows.shape[1] - 1, -1, -1):
            number = rows[at, k]
            new_lo = np.where(number > 0, self.before[number] + self.rank(number, lo), lo)
            new_hi = np.where(number > 0, self.before[number] + self.rank(number, hi), hi)
            live = new_lo < new_hi
            at, lo, hi = at[live], new_lo[live], new_hi[live]
        return at, lo, hi

    def locate(self, rows):
        """Positions of suffixes by their place in the order."""
        import numpy as np

        rows, found, steps, open_ = rows.copy(), np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.is_sample[here]
            found[open_[done]] = self.samples[self.sample_rank[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            number = self.last[here].astype(np.int64)
            rows[open_] = self.before[number] + self.rank(number, here)
            steps += 1
        return found


def _runs(numbers, least: int):
    """Begin and end of the stretches of at least ``least`` numbers above 0."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[0], numbers > 0, [0]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    keep = end - begin >= least
    return begin[keep], end[keep]


def occurrences(numbers, phrases: Phrases):
    """(phrase, position) of every occurrence of a phrase in ``numbers`` (0: a word of no item, or a text's end)."""
    import numpy as np

    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.lengths):
        return nothing
    begin, end = _runs(numbers, int(phrases.lengths.min()))
    if not len(begin):
        return nothing
    places: dict[bytes, list[int]] = {}
    for lo, hi in zip(begin.tolist(), end.tolist()):
        places.setdefault(numbers[lo:hi].tobytes(), []).append(lo)
    distinct = [np.frombuffer(run, numbers.dtype) for run in places]
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in distinct])])
    index = FMIndex(np.concatenate([np.append(r, 1) for r in distinct]), len(phrases.numbers) + 1)
    at, lo, hi = index.search(phrases.rows)
    if not len(at):
        return nothing
    count = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    phrase, where = np.repeat(at, count), index.locate(rows)
    run = np.searchsorted(starts, where, side="right") - 1
    copies = np.array([len(x) for x in places.values()])
    first = np.concatenate([[0], np.cumsum(copies)[:-1]])
    all_places = np.concatenate([np.array(x) for x in places.values()])
    times = copies[run]
    copy = np.arange(times.sum()) - np.repeat(np.concatenate([[0], np.cumsum(times)[:-1]]), times)
    return np.repeat(phrase, times), all_places[np.repeat(first[run], times) + copy] + np.repeat(where - starts[run], times)


def _benchmark(folder: str, window: int) -> Iterator[Phrases]:
    """Blocks of the items' phrases; a benchmark of one block is kept by the worker."""
    import pyarrow.dataset as ds

    if (folder, window) in _blocks:
        yield from _blocks[folder, window]
        return
    store, path = shared_files.file_system(folder)
    items, size, made, first = [], 0, 0, None
    for batch in ds.dataset(path, filesystem=store, format="parquet").to_batches(columns=["item_id", "text"], batch_size=64):
        for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            if words := words_of(text):
                items.append((item_id, words))
                size += len(words)
            if size >= BLOCK_WORDS:
                yield Phrases(items, window)
                items, size, made = [], 0, made + 1
    if items:
        first = Phrases(items, window)
        yield first
    if not made:
        _blocks.clear()
        _blocks[folder, window] = [first] if first else []


def _judge(texts: list, blocks: Iterator[Phrases]) -> tuple:
    """Per text: number of words, merged spans of hit words, item ids."""
    import numpy as np

    words = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])  # an end after each text
    step = np.zeros(starts[-1] + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    for phrases in blocks:
        get, numbers = phrases.numbers.get, np.zeros(starts[-1], np.int32)
        for k, own in enumerate(words):
            numbers[starts[k] : starts[k] + len(own)] = np.fromiter(map(get, own, repeat(0)), np.int32, len(own))
        phrase, where = occurrences(numbers, phrases)
        np.add.at(step, where, 1)
        np.add.at(step, where + phrases.lengths[phrase], -1)
        doc = np.searchsorted(starts, where, side="right") - 1
        for d, p in np.unique(np.stack([doc, phrase], axis=1), axis=0).tolist():
            items[d].update(phrases.items[p])
    hit = np.cumsum(step)[:-1]
    begin, end = _runs(hit, 1)
    doc = np.searchsorted(starts, begin, side="right") - 1
    spans: list[list] = [[] for _ in texts]
    for d, lo, hi in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist()):
        spans[d].append((lo, hi))
    return counts.tolist(), spans, [sorted(x) for x in items]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first word to its last."""
    import re

    folded = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", folded.translate(FOLD))]
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(folded[at : places[lo][0]])
        at = places[hi - 1][1]
    return b"".join([*kept, folded[at:]]).decode()


def _write_benchmark(benchmark: DataFrame) -> str:
    folder = scratch_path(benchmark.sparkSession, "benchmark")
    columns = [F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")]
    benchmark.select(*columns).write.mode("overwrite").parquet(folder)
    return folder


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, merged spans of hit words and the sorted ids of the items found, per document."""
    folder = _write_benchmark(benchmark)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in text_batches(batches, "text", SHARD_BYTES):
            counts, spans, items = _judge(batch.column("text").to_pylist(), _benchmark(folder, window))
            spans = [[{"begin": lo, "end": hi} for lo, hi in s] for s in spans]
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(find, FOUND)


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the hit spans, ``n_chars`` (if there) counted anew for them; all else is unchanged."""
    folder = _write_benchmark(benchmark)
    schema = docs.schema

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches, "text", SHARD_BYTES):
            texts = batch.column("text").to_pylist()
            _, spans, _ = _judge(texts, _benchmark(folder, window))
            if any(spans):
                texts = [without_spans(t, s) if s else t for t, s in zip(texts, spans)]
                fresh = {"text": texts}
                if "n_chars" in batch.schema.names:
                    before = batch.column("n_chars").to_pylist()
                    fresh["n_chars"] = [len(t) if s else n for t, s, n in zip(texts, spans, before)]
                for name, values in fresh.items():
                    at = batch.schema.get_field_index(name)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return small_batches(docs).mapInArrow(clean, schema)


def report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items of each document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
