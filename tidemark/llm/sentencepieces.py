"""SentencePiece ids with the bytes of the source that each piece stands for.

Normalisation is done here, with offsets: at each place the longest key of the model's compiled character
map (a double-array trie, then replacement texts) that the source begins with is replaced; without one, one character is
copied, and a malformed byte becomes U+FFFD. Every byte of the result remembers the source byte it came from. The
model's merges then run on that text (the sentencepiece library with normalisation switched off), and
each piece's bytes are projected back to a span of source bytes. Pieces of one character's bytes share it
as the library has it: all but the last are empty spans at its beginning.

Speed: no piece of the usual vocabularies has a space behind another character, so merges never cross
from such a character to a space. Texts are cut there, and each distinct cut is normalised and encoded once and
remembered (a bounded memory that is emptied when full). Where a cut ends in a space after normalisation, it is joined to the
next one. Models that strip or append spaces, define their own symbols or have keys or pieces across spaces encode
texts whole.

Defined cases: a null or empty text has no pieces and decodes to the empty text. Malformed UTF-8 is
replaced as above. Rows are independent, so equal rows and repeated doc_ids stay as they are. An empty table
gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

SPACE = "▁".encode()
MALFORMED = "�".encode()
#: Distinct cuts, and ids of them, that a worker remembers.
REMEMBERED, REMEMBERED_IDS = 200_000, 2_000_000
#: The library looks at so many keys that begin a text.
MOST_KEYS = 32
#: Kinds of pieces in a model file.
UNKNOWN, OWN_SYMBOL, BYTE = 2, 4, 6

_encoders: dict[str, Encoder] = {}


class CharacterMap:
    """The compiled map: a 32-bit size, a double array of 32-bit units of that size, and texts that end in a zero byte."""

    def __init__(self, blob: bytes):
        import numpy as np

        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def children(self, node: int) -> Iterator[tuple[int, int, int | None]]:
        """(byte, node behind it, place of the text if a key ends there)."""
        for byte in range(1, 256):
            unit = self.units[node ^ byte] if node ^ byte < len(self.units) else 0
            if unit & 0x800000FF == byte:
                after = node ^ byte ^ self._offset(unit)
                yield byte, after, self.units[after] & 0x7FFFFFFF if unit >> 8 & 1 else None

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, length) of the longest key at a place; length 0 without one."""
        if not self.units:
            return b"", 0
        node, value, length, keys = self._offset(self.units[0]), None, 0, 0
        for i in range(at, len(text)):
            unit = self.units[node ^ text[i]]
            if unit & 0x800000FF != text[i]:
                break
            node ^= text[i] ^ self._offset(unit)
            if unit >> 8 & 1:
                value, length, keys = self.units[node] & 0x7FFFFFFF, i + 1 - at, keys + 1
                if keys == MOST_KEYS:
                    break
        if not length:
            return b"", 0
        return self.texts[value : self.texts.index(0, value)], length

    def crosses_spaces(self) -> bool:
        """Whether a key has a space behind its first byte."""
        if not self.units:
            return False
        nodes = [after for _, after, _ in self.children(self._offset(self.units[0]))]
        while nodes:
            node, found = nodes.pop(), None
            for found in self.children(node):
                if found[0] == 32:
                    return True
                nodes.append(found[1])
        return False


def character_length(text: bytes, at: int) -> int:
    """Bytes of the well-formed character at a place, 0 if it is malformed."""
    first = text[at]
    n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    try:
        return n if len(text[at : at + n].decode()) == 1 else 0
    except UnicodeDecodeError:
        return 0


class Normaliser:
    """Normalised bytes and, for each of them and their end, the place in the source."""

    def __init__(self, spec, suffix: bool, symbols: list[bytes] = ()):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.space = SPACE if spec.escape_whitespaces else b" "
        self.dummy, self.strips, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix
        self.symbols = sorted(symbols, key=len, reverse=True)

    def replaced(self, text: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.symbols:
            if text.startswith(symbol, at):
                return symbol, len(symbol)
        new, length = self.map.longest(text, at)
        if length:
            return new, length
        length = character_length(text, at)
        return (text[at : at + length], length) if length else (MALFORMED, 1)

    def bodies(self, texts: list[bytes]) -> tuple:
        """``body`` of texts that begin with a space: (results, all their places in a row)."""
        import numpy as np

        raw = b"".join(texts)
        try:
            whole = not self.map.units and raw.decode()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            found = [self.body(t) for t in texts]
            return [t.decode() for t, _ in found], np.concatenate([a for _, a in found]) if found else np.zeros(0, int)
        # Without a map only spaces change; bytes that continue a character come from its beginning.
        of, sizes = np.frombuffer(raw, np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        begin = np.maximum.accumulate(np.where(of & 0xC0 == 0x80, 0, np.arange(len(of)))) - np.repeat(starts, sizes)
        wide = np.where(of == 32, len(self.space), 1)
        ends = np.cumsum(np.add.reduceat(wide, starts))
        space = self.space.decode()
        return [t.decode().replace(" ", space) for t in texts], np.insert(np.repeat(begin, wide), ends, sizes)

    def body(self, text: bytes) -> tuple:
        """The text's characters replaced, no space added or stripped."""
        import numpy as np

        out, places, at = [], [], 0
        while at < len(text):
            new, length = self.replaced(text, at)
            new = new.replace(b" ", self.space)
            out.append(new)
            places += [at] * len(new)
            at += length
        return b"".join(out), np.array([*places, at])

    def whole(self, text: bytes) -> tuple:
        import numpy as np

        if not text:
            return b"", np.zeros(1, int)
        out, places, at = [], [], 0
        while self.strips and at < len(text):
            new, length = self.replaced(text, at)
            if new != b" ":
                break
            at += length
        if at == len(text):
            return b"", np.zeros(1, int)
        if self.dummy and not self.suffix:
            out.append(self.space)
            places += [at] * len(self.space)
        behind_space = self.strips
        while at < len(text):
            new, length = self.replaced(text, at)
            if behind_space:
                new = new.lstrip(b" ")
            if new:
                behind_space = self.strips and new.endswith(b" ")
                new = new.replace(b" ", self.space)
                out.append(new)
                places += [at] * len(new)
            at += length
        found, end = b"".join(out), at
        while self.strips and found.endswith(self.space):
            found = found[: -len(self.space)]
            end = places[len(found)]
        places = places[: len(found)]
        if self.dummy and self.suffix:
            found += self.space
            places += [end] * len(self.space)
        return found, np.array([*places, end])


class Encoder:
    """Ids and source spans of whole texts."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec, suffix = model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix
        pieces = [(p.piece.encode(), p.type) for p in model.pieces]
        symbols = [p for p, kind in pieces if kind == OWN_SYMBOL]
        self.normaliser = Normaliser(spec, suffix, symbols)
        across = any("▁" in p.piece.lstrip("▁") for p in model.pieces)
        self.cuts = (
            spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
            and not (suffix or symbols or across or self.normaliser.map.crosses_spaces())
        )
        self.bytes_of = np.array([0 if kind == UNKNOWN else 1 if kind == BYTE else len(p) for p, kind in pieces])
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.places: dict[bytes, int] = {}
        self.open = np.zeros(0, bool)  # whether a cut ends in a space
        self.values, self.starts = np.zeros((3, 0), np.int32), np.zeros(1, np.int64)

    def spans(self, texts: list[str], align) -> tuple:
        """((ids, begins, ends) of all normalised texts in a row, number of ids of each).

        ``align``: the texts' places in a row; each text has one more than it has bytes.
        """
        from itertools import chain

        import numpy as np

        lists = self.merges.encode(texts, num_threads=1)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, n.sum())
        size = self.bytes_of[ids] if len(ids) else np.zeros(0, np.int64)
        for k in np.flatnonzero(np.add.reduceat(size == 0, (np.cumsum(n) - n)[n > 0]) > 0) if len(ids) else ():
            k = np.flatnonzero(n > 0)[k]  # unknown pieces are as long as their text
            at = n[:k].sum()
            size[at : at + n[k]] = [self.bytes_of[i] or len(p.encode()) for i, p in zip(lists[k], self.merges.encode(texts[k], out_type=str))]
        # What precedes a text: its ids' bytes before, and one place more for each text before.
        places = np.zeros(len(texts), np.int64)
        places[n > 0] = np.add.reduceat(size, (np.cumsum(n) - n)[n > 0]) if len(ids) else 0
        first = np.cumsum(places + 1) - places - 1
        end = np.cumsum(size)
        before = np.concatenate([[0], end])[np.cumsum(n) - n]
        end = end - np.repeat(before, n) + np.repeat(first, n)
        return np.array([ids, align[end - size], align[end]], np.int32).reshape(3, -1), n

    def _learn(self, cuts: list[bytes]) -> range:
        """Remember the cuts, each behind a space; returns their places."""
        import numpy as np

        texts, align = self.normaliser.bodies([b" " + c for c in cuts])
        values, n = self.spans(texts, align)
        at = len(self.starts) - 1
        self.values = np.concatenate([self.values, values], axis=1)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
        self.open = np.concatenate([self.open, [t.endswith("▁") for t in texts]]).astype(bool)
        return range(at, at + len(cuts))

    def encode(self, texts) -> tuple:
        """((ids, begins, ends) of all texts in a row, number of ids of each) of a pyarrow binary array without nulls."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.cuts:
            found = [self.normaliser.whole(t) for t in texts.to_pylist()]
            return self.spans([t.decode() for t, _ in found], np.concatenate([np.zeros(0, int), *[a for _, a in found]]))
        if len(self.places) > REMEMBERED or self.starts[-1] > REMEMBERED_IDS:
            self.forget()
        lists = pc.split_pattern(texts, b" ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values
        coded = words.dictionary_encode()
        cuts = coded.dictionary.to_pylist()
        if new := [c for c in cuts if c not in self.places]:
            self.places.update(zip(new, self._learn(new)))
        of_cut = np.fromiter(map(self.places.__getitem__, cuts), np.int64, len(cuts))
        place = of_cut[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        of_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        last = np.zeros(len(words), bool)
        last[offsets[1:] - 1] = True
        joined = self.open[place] & ~last
        kept = None
        if joined.any():  # runs of cuts up to one that ends in no space are one cut
            starts = np.flatnonzero(np.concatenate([[True], ~joined[:-1]]))
            count = np.diff(np.append(starts, len(words)))
            runs = np.flatnonzero(count > 1)
            kept = self.values, self.starts, self.open  # the runs are this batch's own
            place = place[starts]
            place[runs] = self._learn([b" ".join(words.slice(starts[r], count[r]).to_pylist()) for r in runs])
            sizes = np.add.reduceat(sizes, starts) + count - 1
            of_text = of_text[starts]
        # The source byte of the space before each cut; a text's first cut has none.
        whole = np.cumsum(sizes + 1) - (sizes + 1)
        first = np.searchsorted(of_text, np.arange(len(texts)))
        at = whole - whole[first][of_text] - 1
        n = (self.starts[1:] - self.starts[:-1])[place]
        empty = (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)[of_text]
        n[empty] = 0
        ends = np.cumsum(n)
        values = self.values[:, np.repeat(self.starts[place] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        values[1:] = np.maximum(values[1:] + np.repeat(at, n).astype(np.int32), 0)
        if kept:
            self.values, self.starts, self.open = kept
        return values, np.add.reduceat(n, first) if len(n) else n


def encoder(path: str) -> Encoder:
    """This worker's encoder, which keeps its cuts from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and text, ids, and the source bytes [begin, end) of every piece."""
    return _coded(docs, model, decoded=False)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """As ``encode``, without the text, with what the library decodes the ids to."""
    return _coded(docs, model, decoded=True)


def _coded(docs: DataFrame, model: str, decoded: bool) -> DataFrame:
    text = "decoded" if decoded else "text"
    schema = f"doc_id long, {text} string, ids array<int>, begins array<int>, ends array<int>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = encoder(model)
        for batch in text_batches(batches, "text", 4_000_000):
            texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
            values, n = own.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(n)])
            if decoded:
                ids = values[0].tolist()
                out = pa.array(own.library.decode([ids[lo:hi] for lo, hi in zip(offsets, offsets[1:])], num_threads=1), pa.string())
            else:
                out = batch.column("text")
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v)) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out, *lists], names=["doc_id", text, "ids", "begins", "ends"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, schema)
