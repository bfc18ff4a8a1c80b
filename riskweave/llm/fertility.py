"""Quality rules by tokeniser fertility: how well a public vocabulary covers a text.

Words are tokenised by a public SentencePiece vocabulary (each distinct word once per batch and
cache). A text's measures are its characters per token, tokens per word, the share of byte-fallback
tokens and the entropy of its tokens relative to the most its length allows. A text is rejected when a
measure leaves the band of its language (its ``lang``, or its script where that is null). Bands
are Tukey-like fences around the quartiles of all texts of the language that pass the base rules,
drawn toward those of the text's script, and these toward the wide fences ``WIDE``, with a weight that
falls smoothly with the number of texts (scripts differ several times in characters per token, so
one says little of another). Entropy falls with length, so it is
judged by its excess over what texts of that length have, and all fences lie further out for short
texts, whose measures vary more.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import common as c

CACHE_WORDS = 400_000
#: Fences: so many quartile ranges beyond the quartiles, and at least this far beyond them.
FENCE, LEAST = 4.0, {"chars_per_token": 0.2, "tokens_per_word": 1.0, "byte_share": 0.05, "excess": 0.05}
MAX_CHARS_PER_TOKEN = 16.0
WIDE = {"chars_per_token": (0.4, MAX_CHARS_PER_TOKEN), "tokens_per_word": (0.0, 30.0), "byte_share": (0.0, 0.6), "excess": (-0.4, 0.4)}
BOTH = ("chars_per_token", "excess")            # measures with fences on both sides; the others have one above
PRIOR = 10.0                   # the fences that a language's or script's are drawn to count as so many texts
STEADY = 150                   # tokens of a text whose measures vary as much by chance as between texts
OCTAVES, NEXT = 48, 0.01       # lengths with an expected entropy: powers of two; weight of the texts of the next one
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: First and last characters of the scripts told apart (by lead bytes of their UTF-8 form).
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
           ("indic", 0x900, 0xDFF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))


class Words:
    """Token ids of words, kept by word hash in flat arrays of bounded size."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.size)])
        self.clear()

    def clear(self):
        self.at: dict[int, int] = {}
        self.ids, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    def lookup(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray):
        """(flat ids, offsets) tables and each word's entry."""
        u, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        keys = u.tolist()
        missing = [k for k, h in enumerate(keys) if h not in self.at]
        if missing and len(self.at) + len(missing) > CACHE_WORDS:
            self.clear()
            missing = range(len(keys))
        if missing:
            raw = data.tobytes()
            words = [raw[start[first[k]]:end[first[k]]].decode("utf-8", "replace") for k in missing]
            got = self.sp.encode(words, num_threads=1)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self.ids = np.concatenate((self.ids, np.fromiter((i for x in got for i in x), np.int32, int(sizes.sum()))))
            base = len(self.start) - 1
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
            for n, k in enumerate(missing):
                self.at[keys[k]] = base + n
        entry = np.fromiter((self.at[h] for h in keys), np.int64, len(keys))
        return entry[back]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal in its row, has an equal before it in its row)."""
    order = np.lexsort((h, row))                              # stable: equal items stay in text order
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    any_, before = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return any_, before


def repeated_words(hashes: np.ndarray, row: np.ndarray, n_rows: int, n: int = 5) -> np.ndarray:
    """Words of each row that stand in an n-word window found at least twice in it."""
    h, r, at = c.shingles(hashes, row, n_rows, n, short=False)
    again, _ = _again(h, r)
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + n, -1)
    return np.bincount(row[np.cumsum(step)[:-1] > 0], minlength=n_rows)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Lines of each row with a word that equal an earlier line of it."""
    n_rows = len(offsets) - 1
    nl = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1][np.diff(offsets) > 0], nl + 1)))
    start = np.unique(start)
    start = start[start < len(data)]
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.concatenate((start[1:], [len(data)]))
    last = np.minimum(end - 1, len(data) - 1)
    end = np.where((end > start) & (data[last] == 10), end - 1, end) if len(start) else end
    word = np.concatenate(([0], np.cumsum(~c._SEP[data])))
    ok = word[end] > word[start]
    _, before = _again(c.span_hash(s, start[ok], end[ok]), row[ok])
    return np.bincount(row[ok][before], minlength=n_rows)


def scripts_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Each row's most frequent script (``none`` without letters of those told apart)."""
    from riskweave.llm.langid import letters

    ch, off = letters(data, offsets)
    counts = np.stack([_per_row((ch >= lo) & (ch <= hi), off) for _, lo, hi in SCRIPTS])
    return [SCRIPTS[k][0] if n else "none" for k, n in zip(counts.argmax(axis=0), counts.max(axis=0))] if counts.size else []


def _measure(path):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]

    def run(batches):
        words = words_of(path)
        for batch in batches:
            for a, b, data, offsets in c.text_chunks(batch.column(1)):
                n = b - a
                start, end, row = c.word_spans(data, offsets)
                s = c.prefix_hash(data)
                hashes = c.span_hash(s, start, end)
                head = ((data & 0xC0) != 0x80) & ~c._SEP[data]
                word_chars = _per_row(head, offsets)
                entry = words.lookup(hashes, start, end, data)
                size = words.start[entry + 1] - words.start[entry]
                per_word = np.repeat(words.start[entry] - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else np.empty(0, np.int64)
                ids = words.ids[per_word + np.arange(len(per_word))]
                owner = np.repeat(row, size)
                tokens = np.bincount(owner, minlength=n)
                bytes_ = np.bincount(owner[words.is_byte[ids]], minlength=n)
                pair = np.sort(owner * words.size + ids)
                at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
                count = np.diff(np.append(at, len(pair)))
                rows = pair[at] // words.size
                total = np.maximum(tokens, 1)
                p = count / total[rows]
                bits = np.bincount(rows, weights=-p * np.log2(p), minlength=n)
                most = np.log2(np.clip(tokens, 2, words.size))
                cols = [np.bincount(row, minlength=n), word_chars, _per_row(_SYMBOL[data], offsets), duplicate_lines(data, offsets, s),
                        repeated_words(hashes, row, n), tokens]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), *[pa.array(x.astype(np.int64)) for x in cols], pa.array(word_chars / total), pa.array(tokens / np.maximum(cols[0], 1)), pa.array(bytes_ / total),
                     pa.array(bits / most), pa.array(scripts_of(data, offsets), pa.string())],
                    names=["_row", *names, "chars_per_token", "tokens_per_word", "byte_share", "entropy", "script"])

    return run, ", ".join(f"{x} long" for x in names) + ", chars_per_token double, tokens_per_word double, byte_share double, entropy double, script string"


def measures(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """Per input row its ``columns`` (default: all) and the measures of its whole text, and ``key``,
    its language or else script. Null texts have no words."""
    columns = docs.columns if columns is None else columns
    fields = [docs[x].alias(f"c{k}") for k, x in enumerate(columns)] + [docs[lang_col].cast("string").alias("lang")]
    rows = docs.select(F.struct(*fields).alias("_row"), docs[text_col].alias("_text"))
    run, schema = _measure(vocabulary)
    out = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, {schema}")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(*[F.col(f"_row.c{k}").alias(f"c{k}") for k in range(len(columns))], F.coalesce("_row.lang", F.concat(F.lit("script:"), "script")).alias("key"),
                      *[x for x in out.columns if x != "_row"], base.alias("base_failed"))


def expected_entropy(measured: DataFrame):
    """The entropy to expect at ``n_tokens``: medians of the texts that pass the base rules by power
    of two, those of few texts drawn to their neighbours', with straight lines between them."""
    octave = F.round(F.log2(F.greatest("n_tokens", F.lit(2)))).cast("int")
    found = measured.where(~F.col("base_failed")).groupBy(octave.alias("octave")).agg(
        F.count("*").alias("n"), F.percentile_approx("entropy", 0.5, 1000).alias("median")).orderBy("octave").collect()   # a row per power of two
    curve = []
    for k in range(OCTAVES):
        near = min((abs(r.octave - k) for r in found), default=0)
        weight = [r.n * NEXT ** (abs(r.octave - k) - near) for r in found]
        curve.append(sum(w * r.median for w, r in zip(weight, found)) / sum(weight) if found else 0.0)
    at = F.log2(F.greatest("n_tokens", F.lit(2)))
    values, low = F.array(*[F.lit(x) for x in curve]), F.least(F.floor(at), F.lit(OCTAVES - 2)).cast("int")
    return values[low] + (at - low) * (values[low + 1] - values[low])


def _quartiles(ok: DataFrame, by: str) -> DataFrame:
    aggs = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.75)), 1000).alias(x) for x in LEAST]
    cols = [by, F.col("n") / (F.col("n") + F.lit(PRIOR))]
    for x, least in LEAST.items():
        cols += [F.col(x)[0], F.col(x)[1], F.greatest(F.lit(FENCE) * (F.col(x)[1] - F.col(x)[0]), F.lit(least))]
    names = [by, f"{by}_weight", *[f"{by}_{x}_{side}" for x in LEAST for side in ("low", "high", "reach")]]
    return ok.groupBy(by).agg(F.count("*").alias("n"), *aggs).select(*[v.alias(k) if not isinstance(v, str) else v for k, v in zip(names, cols)])


def bands(measured: DataFrame) -> DataFrame:
    """Per ``key`` and ``script`` the bounds ``low`` and ``high`` of each measure and the ``reach`` of the
    fences beyond them, over all texts that pass the base rules."""
    ok = measured.where(~F.col("base_failed"))
    both = ok.select("key", "script").distinct().join(_quartiles(ok, "key"), "key").join(_quartiles(ok, "script"), "script")
    cols = ["key", "script"]
    for x, (low, high) in WIDE.items():
        for side, wide in (("low", low), ("high", high), ("reach", 0.0)):
            w, v = F.col("script_weight"), F.col("key_weight")
            script = w * F.col(f"script_{x}_{side}") + (1 - w) * F.lit(wide)
            cols.append((v * F.col(f"key_{x}_{side}") + (1 - v) * script).alias(f"{x}_{side}"))
    return both.select(*cols)


def judge(docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """Per input row its ``columns``, all measures, ``base_failed`` and ``kept``.

    Rejected beyond the base rules (under 10 words, or over a fifth of the words in repeated
    5-word windows): texts of any length with fewer or more characters per token, more tokens per
    word, more byte fallback, or less or more entropy for their length than their language's fences,
    or more than ``MAX_CHARS_PER_TOKEN``. The fences' reach grows as the root of 1 + ``STEADY`` / tokens. Null and
    empty texts fail the base rules; repeated rows get a row each; an empty table gives no rows."""
    columns = docs.columns if columns is None else columns
    measured = c.stage(measures(docs, vocabulary, text_col, lang_col, columns))
    shown = [x for x in measured.columns if x not in {"script", *[f"c{k}" for k in range(len(columns))]}]
    measured = measured.withColumn("excess", F.col("entropy") - expected_entropy(measured))
    own = bands(measured).withColumnsRenamed({"key": "_key", "script": "_script"})
    j = measured.join(own, (F.col("key") == F.col("_key")) & (F.col("script") == F.col("_script")), "left")
    wider = F.sqrt(1 + F.lit(float(STEADY)) / F.greatest("n_tokens", F.lit(1)))
    out_of_band = F.col("chars_per_token") > MAX_CHARS_PER_TOKEN
    for x in LEAST:
        reach = wider * F.col(f"{x}_reach")
        out_of_band |= F.col(x) > F.col(f"{x}_high") + reach
        if x in BOTH:
            out_of_band |= F.col(x) < F.col(f"{x}_low") - reach
    kept = ~F.col("base_failed") & ~out_of_band
    return j.select(*[F.col(f"c{k}").alias(x) for k, x in enumerate(columns)], *shown, kept.alias("kept"))
