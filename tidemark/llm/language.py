"""Language by cross-parsing: suffix automata of labelled text and the phrases a text needs in each.

A bounded sample of labelled text of each language (SAMPLE_CHARS characters from about SAMPLE_DOCS
documents, drawn by hash over all labelled documents) becomes a suffix automaton. A text is parsed from
left to right into longest matches: a walk from the automaton's root goes on while the text spells a
part of the sample, and a phrase ends where it cannot. Phrases times the logarithm of the sample's
length, over the text's length, estimate the cross-entropy; the language with the least wins. Whole
texts are parsed, in segments of SEGMENT characters that start a phrase of their own, so that all
segments of a batch step through the tables together.

Text is lower-cased; runs of anything but letters are one separator. Score: the runner-up's phrases over
the sum of both, 0.5 to 1 (1 with a single language). Ties go to the first language by code point.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text when
no document is labelled; null labels teach nothing; equal rows are judged alike and teach once; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

SAMPLE_CHARS, SAMPLE_DOCS, SEGMENT = 40_000, 200, 512
#: More labels than this are an error: each has a table in every task.
MOST_LANGUAGES = 200
UNDETERMINED = "und"

_letters = None


def letters():
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        import numpy as np

        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str):
    """Lower-cased letters as code points; runs of other characters as one 0, none in front."""
    import numpy as np

    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, 0)
    return points[(points != 0) | (np.concatenate([[0], points[:-1]]) != 0)]


def automaton(codes: list[int], width: int):
    """Transitions of the suffix automaton of ``codes``: a table of states by codes, 0 for none, the root first."""
    import numpy as np

    link, length, edges = [-1], [0], [{}]
    last = 0
    for c in codes:
        now = len(link)
        link.append(0)
        length.append(length[last] + 1)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:  # q also ends shorter strings: split those off
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    table = np.zeros((len(edges), width), np.int32)
    for state, own in enumerate(edges):
        table[state, list(own)] = list(own.values())
    return table


@dataclass(frozen=True)
class Model:
    """Languages in order, the letters their tables know, and a table and sample length of each."""

    languages: list[str]
    alphabet: object
    tables: list
    lengths: list[int]

    def codes(self, points):
        """1.. for known letters, 0 for separators, the last column for unknown letters."""
        import numpy as np

        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        return np.where(points == 0, 0, np.where(known, at + 1, len(self.alphabet) + 2))

    def phrases(self, texts: list):
        """Phrases of each text (an array of codes) in each language."""
        import numpy as np

        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([*texts, np.zeros(1, np.int64)])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        parts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        start, size = starts[owner] + inside, np.minimum(SEGMENT, lengths[owner] - inside)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        width = len(self.alphabet) + 3
        count = np.zeros((len(self.tables), len(owner)), np.int64)
        flat_tables = [t.ravel() for t in self.tables]
        state = np.zeros((len(self.tables), len(owner)), np.int32)
        live = np.searchsorted(-size, -np.arange(SEGMENT), side="left")
        for step in range(SEGMENT):
            n = int(live[step])
            if not n:
                break
            code = flat[start[:n] + step]
            for k, t in enumerate(flat_tables):
                before = state[k, :n]
                after = t[before * np.int64(width) + code]
                # At the root, as after an unknown letter (a phrase of its own), no phrase is open.
                count[k, :n] += (after == 0) | (before == 0)
                state[k, :n] = np.where(after == 0, t[code], after)
        return np.stack([np.bincount(owner, c, minlength=len(texts)) for c in count], axis=1)

    def judge(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        import numpy as np

        points = [code_points(t or "") for t in texts]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = [k for k, p in enumerate(points) if len(p)]
        if not some or not self.languages:
            return names, scores
        cost = self.phrases([self.codes(points[k]) for k in some]) * np.log2(np.array(self.lengths) + 2.0)
        for k, own in zip(some, cost):
            order = np.argsort(own, kind="stable")
            names[k] = self.languages[order[0]]
            scores[k] = float(own[order[1]] / (own[order[0]] + own[order[1]])) if len(order) > 1 else 1.0
        return names, scores


def sample(labelled: DataFrame, chars: int = SAMPLE_CHARS, docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Pieces of labelled text of each language, at most about ``chars`` characters of it."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    rows = rows.filter("lang IS NOT NULL AND length(text) > 0").select(
        "lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).alias("draw")
    )
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    if not counts:
        return {}
    # Four standard deviations more than wanted, so that the least ``docs`` draws are among them.
    wanted = [(r[0], min(1.0, (docs + 4 * docs**0.5) / r[1]) * float(1 << 53), -(-chars // min(docs, r[1]))) for r in counts]
    bounds = F.broadcast(spark.createDataFrame(wanted, "lang string, bound double, size int"))
    begin = (F.col("draw") % F.greatest(F.lit(1), F.length("text") - F.col("size") + 1) + 1).cast("int")
    drawn = rows.join(bounds, "lang").filter(F.col("draw") < F.col("bound"))
    pieces = drawn.select("lang", "draw", F.substr("text", begin, F.col("size")).alias("piece")).distinct().collect()
    found: dict[str, list[str]] = {}
    for lang, _, piece in sorted(pieces):
        if len(found.setdefault(lang, [])) < docs:
            found[lang].append(piece)
    return found


def fit(labelled: DataFrame, chars: int = SAMPLE_CHARS, docs: int = SAMPLE_DOCS) -> Model:
    """Automata of a sample of ``labelled`` (doc_id, text, lang)."""
    return of_pieces(sample(labelled, chars, docs))


def of_pieces(pieces: dict[str, list[str]]) -> Model:
    import numpy as np

    points = {lang: [p for p in map(code_points, texts) if len(p)] for lang, texts in pieces.items()}
    languages = sorted(lang for lang, p in points.items() if p)
    if not languages:
        return Model([], np.zeros(0, np.uint32), [], [])
    alphabet = np.unique(np.concatenate([p for lang in languages for p in points[lang]]))
    alphabet = alphabet[alphabet > 0]
    model = Model(languages, alphabet, [], [])
    between = len(alphabet) + 1  # stands between pieces and in no text
    for lang in languages:
        codes = [c for p in points[lang] for c in (*model.codes(p).tolist(), between)]
        model.tables.append(automaton(codes, len(alphabet) + 3))
        model.lengths.append(len(codes))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches, "text", 4_000_000):
            names, scores = shared.value.judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(judge, "doc_id long, lang_pred string, score double")
