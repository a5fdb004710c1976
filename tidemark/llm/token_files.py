"""Token ids as Arrow IPC files of equal-length sequences.

A shard holds the documents of one range of doc_id. Its ids, an end id after each document,
are cut into sequences of one length and written as record batches of one row count with two
fixed-size-list columns, ``ids`` and ``mask`` (false only behind the shard's last id). So the
batch and row of any sequence are known by arithmetic, and a memory map serves it without a
copy. A second Arrow file beside it names each document's offset and length.

Encoding: the text is cut before every space that is followed by another character. A pre-token
of a byte-level tokenizer reaches across such a place only inside a run of white space, where the
space has white space on both sides. So each distinct piece is encoded once by the tokenizers
library and remembered (a bounded memory; when it is full, pieces that came again since the last time stay). Texts with runs of spaces, a
space between other white space, a trailing space or an added token's string are encoded whole.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows of equal
doc_id are ordered by their text's hash, and equal rows are interchangeable. An empty table has
no shard and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import shared_files
from .common import small_batches, text_batches

MANIFEST = "shard int, ids_path string, index_path string, n_docs long, n_ids long"
LENGTH = 2048
#: Rows of a record batch.
BATCH_ROWS = 256
#: Distinct pieces a task remembers.
REMEMBERED = 600_000
#: A word and what follows it in its piece: a byte-level pre-tokenizer always cuts between them.
WORD_AND_REST = re.compile(r"([^\W_]+)([\W_].*)", re.DOTALL)
#: White space as the tokenizers library's pre-tokenizer has it.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_encoders: dict[str, Encoder] = {}


@cache
def byte_alphabet() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable ones as themselves, the others in order from U+0100 on; a
    space, which opens a word here, stands behind a space."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    table = {b: chr(256 + k) for k, b in enumerate(others)}
    return table | {32: " " + table[32]}


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # ``Ġ`` is how byte-level vocabularies write a space; other kinds are encoded whole.
        cutter = self.tokenizer.pre_tokenizer
        self.by_piece = (
            type(cutter).__name__ == "ByteLevel" and cutter.use_regex and not cutter.add_prefix_space and self.tokenizer.normalizer is None
        )
        if self.by_piece:
            # For words of letters, which are one pre-token each, cutting at spaces does and costs less.
            self.letters = Tokenizer.from_file(path)
            self.letters.pre_tokenizer = WhitespaceSplit()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        import numpy as np

        #: Place of each remembered piece (opened by a space) and of each text's first piece.
        self.places: dict[str, int] = {"": 0}  # stands first in a text only
        self.firsts: dict[str, int] = {}
        self.rests: dict[str, int] = {}  # places of what follows a word
        self.ids, self.starts = np.zeros(0, self.dtype), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)  # whether a place's piece came again

    def sweep(self) -> None:
        """Keep the pieces that came again since the last sweep, at most half of what is remembered."""
        import numpy as np

        again = np.zeros(len(self.starts) - 1, bool)
        again[: len(self.again)] = self.again
        ids, starts = self.ids, self.starts
        kept = [[(p, k) for p, k in known.items() if again[k]][-REMEMBERED // 4 :] for known in (self.places, self.firsts)]
        self.forget()
        for known, pieces in zip((self.places, self.firsts), kept):
            known.update(zip([p for p, _ in pieces], self._append([ids[starts[k] : starts[k + 1]] for _, k in pieces])))

    def whole(self, texts: list[str]) -> list:
        import numpy as np

        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _append(self, lists: list) -> range:
        """Places of the lists among the remembered ids."""
        import numpy as np

        at = len(self.starts) - 1
        ends = self.starts[-1] + np.cumsum([len(x) for x in lists], dtype=np.int64)
        self.ids, self.starts = np.concatenate([self.ids, *lists]), np.concatenate([self.starts, ends])
        return range(at, at + len(lists))

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces as one text and cut its ids where an id opens with a space.

        A pre-token ends with the last letter or digit before any other character, so a piece of a word and more has the
        ids of the word, then those of the rest. Pieces that begin with white space could join the end of the piece before; they stand alone.
        """
        import numpy as np

        words, mixed = [], []
        for p in pieces:
            (words if p.isalpha() else mixed).append(p)
        bare = {p: m.groups() for p in mixed if (m := WORD_AND_REST.fullmatch(p))}
        more = dict.fromkeys(c for p in mixed if (c := bare[p][0] if p in bare else p) not in self.places)
        known = set(words)
        words += [c for c in more if c.isalpha() and c not in known]
        plain = [p for p in more if not p.isalpha() and p[0] not in WHITE]
        white = [p for p in more if p[0] in WHITE]
        if white:
            self.places.update(zip(white, self._append(self.whole([" " + p for p in white]))))
        for part, of_letters in [(p[lo : lo + 20_000], p is words) for p in (words, plain) for lo in range(0, len(p), 20_000)]:
            text = " " + " ".join(part)
            if of_letters:
                text = text.encode().decode("latin-1").translate(byte_alphabet())
                ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            else:
                ids = self.whole([text])[0]
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(part):
                raise AssertionError("pieces of a text met in one token")
            at = len(self.starts) - 1
            self.starts = np.concatenate([self.starts, np.append(cuts[1:], len(ids)) + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.places.update(zip(part, range(at, at + len(part))))
        new = list({rest for _, rest in bare.values() if rest not in self.rests})
        self.rests.update(zip(new, self._append(self.whole(new))))
        if bare:
            both = np.empty((len(bare), 2), np.int64)
            both[:, 0] = np.fromiter((self.places[word] for word, _ in bare.values()), np.int64, len(bare))
            both[:, 1] = np.fromiter((self.rests[rest] for _, rest in bare.values()), np.int64, len(bare))
            n = (self.starts[1:] - self.starts[:-1])[both.ravel()]
            ends = np.cumsum(n)
            at = np.repeat(self.starts[both.ravel()] - (ends - n), n) + np.arange(ends[-1])
            first = len(self.starts) - 1
            self.starts = np.concatenate([self.starts, self.starts[-1] + ends[1::2]])
            self.ids = np.concatenate([self.ids, self.ids[at]])
            self.places.update(zip(bare, range(first, first + len(bare))))

    def encode(self, texts) -> tuple:
        """(ids of all texts in a row, number of ids of each) of a pyarrow string array without nulls."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.places) + len(self.firsts) + len(self.rests) > REMEMBERED:
            self.sweep()
        known = len(self.starts) - 1
        odd = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
        odd = pc.or_(odd, pc.match_substring_regex(texts, f"[{WHITE}] [{WHITE}]"))
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)) if self.by_piece else np.arange(len(texts))
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values
        rest = slice(None)
        if len(odd):
            rest = np.ones(len(words), bool)
            for k in odd:
                rest[offsets[k] : offsets[k + 1]] = False
        coded = (words.filter(pa.array(rest)) if len(odd) else words).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.places.get, pieces))
        new = [k for k, place in enumerate(found) if place is None]
        self._learn([pieces[k] for k in new])
        for k in new:
            found[k] = self.places[pieces[k]]
        heads = words.take(pa.array(offsets[:-1])).to_pylist()
        if new := [h for h in dict.fromkeys(heads) if h not in self.firsts]:
            self.firsts.update(zip(new, self._append(self.whole(new))))
        of_piece = np.fromiter(found, np.int64, len(pieces))
        if len(self.again) < len(self.starts) - 1:
            self.again = np.append(self.again, np.zeros(len(self.starts) - 1 - len(self.again), bool))
        self.again[of_piece[of_piece < known]] = True
        # This batch's own lists, an empty one and the odd texts, stand behind the remembered ones.
        kept = self.ids, self.starts
        own = self._append([np.zeros(0, self.dtype), *self.whole(texts.take(pa.array(odd)).to_pylist())])
        place = np.full(len(words), own[0], np.int64)
        place[rest] = of_piece[coded.indices.to_numpy(zero_copy_only=False)]
        place[offsets[:-1]] = np.fromiter(map(self.firsts.__getitem__, heads), np.int64, len(heads))
        place[offsets[odd]] = own[1:]
        begin = np.concatenate([[0], np.cumsum((self.starts[1:] - self.starts[:-1])[place])])
        known = pa.ListArray.from_arrays(pa.array(self.starts.astype(np.int32)), pa.array(self.ids))
        ids = known.take(pa.array(place)).flatten().to_numpy()
        self.ids, self.starts = kept
        return ids, np.diff(begin[offsets])


def encoder(path: str) -> Encoder:
    """This worker's encoder, which keeps its pieces from task to task until the files are read."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Sequences:
    """Collects ids and writes them as full batches of equal-length sequences."""

    def __init__(self, path: str, dtype, length: int, rows: int):
        import numpy as np
        import pyarrow as pa

        self.length, self.rows, self.dtype, self.held, self.n, self.total = length, rows, dtype, [], 0, 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = shared_files.create(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.full = pa.array(np.ones(length * rows, bool))

    def add(self, ids) -> None:
        import numpy as np

        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        step = self.length * self.rows
        if self.n >= step:
            ids = np.concatenate(self.held)
            for lo in range(0, self.n - step + 1, step):
                self._write(ids[lo : lo + step], self.full)
            self.held = [ids[self.n // step * step :].copy()]
            self.n = len(self.held[0])

    def _write(self, ids, mask) -> None:
        import pyarrow as pa

        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        import numpy as np
        import pyarrow as pa

        if self.n:
            ids = np.concatenate([*self.held, np.zeros(-self.n % self.length, self.dtype)])
            self._write(ids, pa.array(np.arange(len(ids)) < self.n))
        self.writer.close()
        self.sink.close()


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = LENGTH, rows: int = BATCH_ROWS
) -> DataFrame:
    """Write the documents' ids in ascending doc_id order under ``folder``; returns the manifest."""

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        own, out, docs_seen = encoder(tokenizer), None, 0
        index_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_ids", pa.int64())])
        for batch in text_batches(batches, "text", 4_000_000, release_every=8):
            if out is None:
                paths = [shared_files.new_name(folder, label, ".arrow") for label in ("ids", "index")]
                out = _Sequences(paths[0], own.dtype, length, rows)
                index_sink = shared_files.create(paths[1])
                index = pa.ipc.new_file(index_sink, index_schema)
            ids, n = own.encode(pc.fill_null(batch.column("text"), ""))
            ends = np.cumsum(n)
            offset = out.total + np.concatenate([[0], ends[:-1]]) + np.arange(len(n))
            out.add(np.insert(ids, ends, end_id))
            index.write_batch(
                pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(offset), pa.array(n + 1)], schema=index_schema)
            )
            docs_seen += len(n)
        if out is not None:
            out.close()
            index.close()
            index_sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": TaskContext.get().partitionId(), "ids_path": paths[0], "index_path": paths[1],
                  "n_docs": docs_seen, "n_ids": out.total}],
                schema=pa.schema([("shard", pa.int32()), ("ids_path", pa.string()), ("index_path", pa.string()),
                                  ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = small_batches(rows_in).repartitionByRange(*order).sortWithinPartitions(*order)
    return shared_files.committed(placed.mapInArrow(write, MANIFEST), folder)


class Sequences:
    """Random access to the sequences of one file; a memory-mapped file gives views, not copies."""

    def __init__(self, path: str):
        import pyarrow as pa

        self.file = pa.ipc.open_file(shared_files.open_random(path))
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.length = self.file.schema.field("ids").type.list_size

    def __getitem__(self, k: int) -> tuple:
        """(ids, mask) of sequence k."""
        batch = self.file.get_batch(k // self.rows)
        return tuple(c[k % self.rows].values.to_numpy(zero_copy_only=c.type.value_type != "bool") for c in batch.columns)

    def ids(self, start: int, n: int) -> Iterator:
        """The ids from ``start`` on, as one piece for each batch they lie in."""
        step = self.rows * self.length
        while n:
            values = self.file.get_batch(start // step).column("ids").values.to_numpy()
            piece = values[start % step :][:n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, on request, its ids."""
    starts = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select(
        "shard", "ids_path", "index_path", F.coalesce(F.sum("n_ids").over(starts), F.lit(0)).alias("base")
    )
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        _encoders.clear()  # the worker may go on to work that needs the memory
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            for shard in batch.to_pylist():
                sequences = Sequences(shard["ids_path"])
                index = pa.ipc.open_file(shared_files.open_random(shard["index_path"]))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    checks, texts = [], []
                    for offset, n in zip(part.column("offset").to_pylist(), part.column("n_ids").to_pylist()):
                        check, pieces = 0, []
                        for piece in sequences.ids(offset, n):
                            check = zlib.crc32(piece.astype("<u4").tobytes(), check)
                            if with_ids:
                                pieces.append(piece.astype(np.int32))
                        checks.append(check)
                        if with_ids:
                            texts.append(np.concatenate(pieces))
                    columns = [part.column("doc_id"), pa.array(part.column("offset").to_numpy() + shard["base"]),
                               part.column("n_ids"), pa.array(checks, pa.int64())]
                    columns += [pa.array(texts, types[4])] if with_ids else []
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return shared_files.one_task_each(shards, "shard").mapInArrow(read, schema)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the documents to the shared folder and read the files back."""
    return read_tokens(write_tokens(docs, scratch_path(spark, "tokens"), tokenizer, end_id))
