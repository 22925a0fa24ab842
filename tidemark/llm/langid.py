"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary. Each language has a probability for every piece,
fitted by expectation maximisation over all segmentations of its words. A word's likelihood is the
sum over all its segmentations, from a forward pass; a text's is the product over its words. The
fit uses a sample bounded by ``DOCS`` rows a language, the first by a hash of their ids and texts;
every text is scored whole, runs of letters of any length too, and each distinct word of a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, columns_of, crc_of_id, text_slices
from tidemark.llm.toxicity import word_lists

#: Training rows a language; Spark finds them with a group limit in each task up to 1000.
DOCS = 600
#: Languages with fewer training rows than this are still learned; there may be at most so many languages.
MAX_LANGUAGES = 256
#: Runs longer than this are summed with their scale kept apart, in blocks of places; cells of those that the fit takes at once.
LONG, PLACES, CELLS = 64, 4096, 1 << 22
ROUNDS = 5
UNKNOWN = 1e-7
REMEMBERED = 400_000
BATCH_BYTES = 4 << 20
BEGIN = "▁"
UND = "und"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def pieces(path: str) -> dict[str, int]:
    """Number of each usable piece: letters, with or without the mark of a word's begin."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    names = sorted({p.id_to_piece(i) for i in range(p.get_piece_size())})
    fit = [n for n in names if n == BEGIN or n.removeprefix(BEGIN).isalpha()]
    return {n: k for k, n in enumerate(fit)}


def longest(known: dict[str, int]) -> int:
    return max(map(len, known), default=1)


_BASE = 0x9E3779B97F4A7C15


def _prefixes(letters: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the prefixes of each row of code points, modulo 2**64."""
    out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(letters.shape[1]):
            out[:, j + 1] = out[:, j] * np.uint64(_BASE) + letters[:, j]
    return out


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


_TABLES: dict[int, tuple[dict[str, int], list[tuple[np.ndarray, np.ndarray]]]] = {}


def _table(known: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the sorted hashes of the pieces that long, and their numbers."""
    if _TABLES.get(id(known), (None,))[0] is not known:
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        for l in range(1, longest(known) + 1):
            names = [n for n in known if len(n) == l]
            h = _prefixes(_letters(names))[:, -1] if names else np.zeros(0, np.uint64)
            order = np.argsort(h)
            out.append((h[order], np.array([known[n] for n in names], np.int32)[order]))
        _TABLES.clear()
        _TABLES[id(known)] = (known, out)
    return _TABLES[id(known)][1]


def grids(words: list[str], known: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length: (their places, for each end j and piece length l the piece that ends there; unknown ones are last).

    Pieces are met by 64-bit hashes of all substrings of a group of words at once.
    """
    none, by, tables = len(known), {}, _table(known)
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, at in by.items():
        for some in (at[k : k + 8192] for k in range(0, len(at), 8192)):
            grid = np.full((len(some), n + 1, len(tables)), none, np.int32)
            upto = _prefixes(_letters([words[k] for k in some])) if n else None
            for l in range(1, min(len(tables) - 1, n) + 1):
                keys, numbers = tables[l]
                if len(keys):
                    with np.errstate(over="ignore"):
                        h = upto[:, l:] - upto[:, :-l] * np.uint64(pow(_BASE, l, 1 << 64))
                    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    grid[:, l:, l] = np.where(keys[place] == h, numbers[place], none)
            yield np.array(some), grid


def forward(grid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]; ``table`` has a row a piece and one, zero, for none. A single unknown letter costs UNKNOWN.

    For words of LONG letters or fewer; one that comes near underflow is summed again by ``long_likelihood``.
    """
    w, n, most = grid.shape
    alpha = np.zeros((w, n, table.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n):
        for l in range(1, min(most - 1, j) + 1):
            p = table[grid[:, j, l]]
            if l == 1:
                p = np.maximum(p, UNKNOWN)
            alpha[:, j] += alpha[:, j - l] * p
    return alpha


def long_likelihood(word: str, known: dict[str, int], table: np.ndarray) -> np.ndarray:
    """log P of one run of any length in each language: the forward pass with what it may underflow by kept as a logarithm."""
    most, none, get = longest(known), len(known), known.get
    last = np.zeros((most, table.shape[1]))  # alpha of the last ends, the newest first
    last[0] = 1
    scale = np.zeros(table.shape[1])
    for begin in range(0, len(word), PLACES):
        for j in range(begin + 1, min(begin + PLACES, len(word)) + 1):
            p = table[[get(word[j - l : j], none) if l <= j else none for l in range(1, most + 1)]]
            p[0] = np.maximum(p[0], UNKNOWN)
            new = (last * p).sum(0)
            last = np.concatenate([new[None], last[:-1]])
            if j % 8 == 0:
                top = last.max(0)
                last /= top
                scale += np.log(top)
    return scale + np.log(last[0])


def log_likelihood(words: list[str], known: dict[str, int], table: np.ndarray) -> np.ndarray:
    """log P(word) in each language, over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    for at, grid in grids([words[k] for k in short], known):
        for k in range(0, len(at), 4096):
            alpha = forward(grid[k : k + 4096], table)[:, -1]
            out[np.asarray(short)[at[k : k + 4096]]] = np.log(np.maximum(alpha, 1e-300))
    again = (np.fromiter(map(len, words), np.int64, len(words)) > LONG) | (out.min(1, initial=0) < -600)
    for k in np.nonzero(again)[0].tolist():
        out[k] = long_likelihood(words[k], known, table)
    return out


def long_counts(words: list[str], counts: np.ndarray, known: dict[str, int], table: np.ndarray) -> np.ndarray:
    """Expected use of each piece, unknown ones last, by runs of any length at once.

    Both passes keep the last values within range and what they were divided by as logarithms.
    """
    most, none = longest(known), len(known)
    size = np.array([len(w) for w in words])
    n, w = int(size.max()), len(words)
    grid = np.full((w, n + 1, most + 1), none, np.int32)
    for at, own in grids(words, known):
        grid[at, : own.shape[1]] = own
    q = table[grid[:, :, 1:]]
    ends = np.arange(n + 1)
    inside = (ends[None] >= 1) & (ends[None] <= size[:, None])
    q[:, :, 0] = np.where(inside, np.maximum(q[:, :, 0], UNKNOWN), 0.0)

    def passed(step, begin: np.ndarray) -> np.ndarray:
        """Logarithms of what ``step`` makes of the last values; ``begin`` is where each run's first value, one, stands."""
        logs, last, scale = np.full((w, n + 1), -np.inf), np.zeros((w, most)), np.zeros(w)
        for t in range(n + 1):
            new = np.where(begin == t, 1.0, (last * step(t)).sum(1))
            with np.errstate(divide="ignore"):
                logs[:, t] = np.log(new) + scale
            last = np.concatenate([new[:, None], last[:, :-1]], 1)
            if t % 8 == 7:
                top = last.max(1)
                top[top == 0] = 1
                last /= top[:, None]
                scale += np.log(top)
        return logs

    lengths = np.arange(1, most + 1)

    def backward(t: int) -> np.ndarray:
        to = n - t + lengths
        return np.where(to <= n, q[:, np.minimum(to, n), lengths - 1], 0.0)

    alpha = passed(lambda t: q[:, t], np.zeros(w, int))
    beta = passed(backward, n - size)[:, ::-1]
    whole = alpha[np.arange(w), size]
    out = np.zeros(none + 1)
    for l in range(1, min(most, n) + 1):
        with np.errstate(divide="ignore"):
            use = np.log(q[:, l:, l - 1]) + alpha[:, : n + 1 - l] + beta[:, l:] - whole[:, None]
        out += np.bincount(grid[:, l:, l].ravel(), (np.exp(use) * counts[:, None]).ravel(), none + 1)
    return out


def expected_counts(words: list[str], counts: np.ndarray, known: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected use of each piece by one language's words: the forward-backward step, over runs of any length."""
    table, out, most = np.append(p, 0.0)[:, None], np.zeros(len(known) + 1), longest(known)
    short = np.array([k for k, w in enumerate(words) if len(w) <= LONG], int)
    far = sorted((k for k, w in enumerate(words) if len(w) > LONG), key=lambda k: len(words[k]))
    while far:  # runs of similar lengths together, as many as their cells allow, one at least
        some = max(1, min(len(far), CELLS // (len(words[far[-1]]) * (most + 1))))
        out += long_counts([words[k] for k in far[-some:]], counts[far[-some:]], known, table[:, 0])
        far = far[:-some]
    for at, grid in grids([words[k] for k in short], known):
        at = short[at]
        alpha = forward(grid, table)[:, :, 0]
        n = grid.shape[1]
        beta = np.zeros_like(alpha)
        beta[:, n - 1] = 1
        share = counts[at] / np.maximum(alpha[:, n - 1], 1e-300)
        for j in range(n - 1, 0, -1):
            for l in range(1, min(most, j) + 1):
                q = table[grid[:, j, l], 0]
                if l == 1:
                    q = np.maximum(q, UNKNOWN)
                beta[:, j - l] += beta[:, j] * q
                out += np.bincount(grid[:, j, l], share * alpha[:, j - l] * q * beta[:, j], len(out))
    return out[:-1]


def fit_language(words: list[str], counts: np.ndarray, known: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    p = np.full(len(known), 1 / max(1, len(known)))
    for _ in range(rounds):
        got = expected_counts(words, counts, known, p) + 0.01
        p = got / got.sum()
    return p


def runs(word: str) -> list[str]:
    """The letter runs of a folded word as the model sees them."""
    if word.isalpha():
        return [BEGIN + word]
    return [BEGIN + p for p in "".join(c if c.isalpha() else " " for c in word).split()]


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, path: str) -> None:
        self.languages, self.table, self.path = languages, table, path

    def scorer(self):
        """Texts to (best language, its probability); remembers words across calls."""
        known, place = pieces(self.path), {}
        scores = np.zeros((1, len(self.languages)))  # row 0: no letters

        def add(words: list[str]) -> np.ndarray:
            nonlocal scores
            if len(place) > REMEMBERED:
                place.clear()
                scores = scores[:1]
            new = list({w: None for w in words if w not in place})
            cut = [runs(w) for w in new]
            flat = list({r: None for c in cut for r in c})
            at = {r: k for k, r in enumerate(flat)}
            each = log_likelihood(flat, known, self.table) if flat else np.zeros((0, scores.shape[1]))
            rows = np.zeros((len(new), scores.shape[1]))
            base = len(scores)
            for k, (w, c) in enumerate(zip(new, cut, strict=True)):
                place[w] = base + k if c else 0
                for r in c:
                    rows[k] += each[at[r]]
            scores = np.concatenate([scores, rows])
            return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

        def score(texts: pa.Array) -> tuple[list[str], np.ndarray]:
            words, row = word_lists(texts)
            coded = words.dictionary_encode()
            at = add(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
            n = len(texts)
            total = np.stack([np.bincount(row, scores[at, k], n) for k in range(scores.shape[1])], 1)
            some = np.bincount(row, at > 0, n) > 0
            total -= total.max(1, keepdims=True)
            p = np.exp(total)
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            return [self.languages[b] if s else UND for b, s in zip(best, some, strict=True)], np.where(some, p[np.arange(n), best], 0.0)

        return score


def _sample(docs: DataFrame) -> DataFrame:
    """Training rows, DOCS a language at most: the first by a hash of id and text, of equal rows one."""
    spark = docs.sparkSession
    train = docs.where(F.col("lang").isNotNull() & F.coalesce(F.pmod(crc_of_id(), F.lit(3)) != 1, F.lit(True)))
    train = train.withColumn("_at", F.xxhash64(F.lit("langid"), "doc_id", "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_at"))
    ends = train.select("lang", "_at").distinct().withColumn("_k", place).where(F.col("_k") <= DOCS)
    rows = ends.groupBy("lang").agg(F.max("_at").alias("last")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    upto = F.broadcast(spark.createDataFrame([(r["lang"], r["last"]) for r in rows], "lang string, last long"))
    return train.join(upto, "lang").where("_at <= last").dropDuplicates(["lang", "_at"]).select("lang", "text")


def fit(docs: DataFrame, path: str | None = None) -> Model:
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words, row = word_lists(batch["text"])
            table = pa.table({"lang": batch["lang"].take(pa.array(row)), "word": words}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from table.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()

    words = arrow_map(_sample(docs), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = words.where("word <> ''").toArrow()  # the words of DOCS texts a language
    by: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(top[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        own = by.setdefault(lang, {})
        for r in runs(word):
            own[r] = own.get(r, 0) + n
    known, languages = pieces(path), sorted(by)
    tables = [fit_language(sorted(by[l]), np.array([by[l][w] for w in sorted(by[l])], float), known) for l in languages]
    return Model(languages, np.append(np.stack(tables, 1), np.zeros((1, len(tables))), 0) if tables else np.zeros((len(known) + 1, 0)), path)


def predictions(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Learned only from rows with a language whose crc32(doc_id) mod 3 is not 1. Defined cases: null
    texts and those without letters are ``und`` with score 0, and so is everything where nothing can
    be learned; null ids are not held out; very long texts, and runs of letters of any length, are
    summed whole; equal scores go to the first language by name; repeated rows give a row each; other
    columns are ignored, also where a name differs in case only; an empty table gives no rows.
    """
    docs = columns_of(docs, "doc_id", "lang", "text")
    model = fit(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in text_slices(batches, "text", BATCH_BYTES):
            if model.languages:
                lang, p = score(batch["text"])
            else:
                lang, p = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()), pa.array(p)], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    held = F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return arrow_map(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
