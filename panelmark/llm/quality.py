"""Quality rules: boosted trees over document statistics, after two fixed rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm import boosting
from panelmark.llm.common import hashed_share, id_and_text, slices, small_batches
from panelmark.llm.wordscan import scramble, span_prints, windows_of, word_spans

#: Labelled rows the trees are fitted on at most (those with the smallest hashed ids).
TRAIN_ROWS = 6000
#: Share of good held-out documents that the verdict may reject.
GOOD_LOST = 0.002
#: A document fails outright with fewer words, or a larger percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_stops", "n_punctuation", "longest_word"]
#: Ratios the trees see, and the direction in which each may move the odds of being good.
FEATURES = {
    "log_words": 0, "chars_a_word": 0, "symbols_a_word": -1, "dup_lines_a_line": -1, "repeated_a_word": -1,
    "distinct_a_word": 0, "digits_a_char": -1, "upper_a_char": 0, "stops_a_word": 0, "punctuation_a_word": 0, "longest_word": 0, "words_a_line": 0,
}


def _by_row(mask_or_values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, mask_or_values, n).astype(np.int64)


def _inside(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set flags between each two offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether its row has it more than once, and whether it is the first one there."""
    mixed = keys ^ scramble(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(mixed, kind="stable")
    ordered = mixed[order]
    new = np.ones(len(mixed), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), len(mixed)))
    many, first = np.zeros(len(mixed), bool), np.zeros(len(mixed), bool)
    many[order] = np.repeat(sizes > 1, sizes)
    first[order] = new
    return many, first


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row of a slice, over whole texts."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    prints = span_prints(data, starts, ends)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    sizes = chars[ends] - chars[starts]
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": _by_row(sizes, rows, n), "n_symbols": _inside(SYMBOLS[data], offsets)}

    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 0x0A
    cut[offsets[:-1]] = True
    line_starts = np.flatnonzero(cut[: len(data)])
    line_ends = np.append(line_starts[1:], len(data))
    line_rows = np.searchsorted(offsets, line_starts, "right") - 1
    words_before = np.searchsorted(starts, np.append(line_starts, len(data)))
    filled = np.diff(words_before) > 0
    line_starts, line_ends, line_rows = line_starts[filled], line_ends[filled], line_rows[filled]
    line_ends = line_ends - (data[line_ends - 1] == 0x0A)
    _many, first = _repeats(span_prints(data, line_starts, line_ends), line_rows)
    out["n_dup_lines"] = _by_row(~first, line_rows, n)

    at, keys = windows_of(prints, rows, 3)
    many, _first = _repeats(keys, rows[at])
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[at[many] + k] = True
    out["n_repeat_words"] = _by_row(covered, rows, n)

    out["n_lines"] = np.bincount(line_rows, minlength=n)
    _many, first = _repeats(prints, rows)
    out["n_distinct"] = _by_row(first, rows, n)
    out["n_digits"] = _inside((data >= 0x30) & (data <= 0x39), offsets)
    out["n_upper"] = _inside((data >= 0x41) & (data <= 0x5A), offsets)
    last = data[ends - 1] if len(ends) else data[:0]
    out["n_stops"] = _by_row((last == ord(".")) | (last == ord("!")) | (last == ord("?")), rows, n)
    out["n_punctuation"] = _by_row((last < 0x30) | (last > 0x39) & (last < 0x41), rows, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, rows, sizes)
    out["longest_word"] = longest
    return {k: out[k] for k in COUNTS}


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(counts[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    of = {
        "log_words": np.log1p(counts["n_words"]), "chars_a_word": counts["word_chars"] / words, "symbols_a_word": counts["n_symbols"] / words,
        "dup_lines_a_line": counts["n_dup_lines"] / lines, "repeated_a_word": counts["n_repeat_words"] / words,
        "distinct_a_word": counts["n_distinct"] / words, "digits_a_char": counts["n_digits"] / chars, "upper_a_char": counts["n_upper"] / chars,
        "stops_a_word": counts["n_stops"] / words, "punctuation_a_word": counts["n_punctuation"] / words,
        "longest_word": counts["longest_word"].astype(float), "words_a_line": counts["n_words"] / lines,
    }
    return np.stack([of[k] for k in FEATURES], axis=1)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


@dataclass
class Rules:
    """Fitted trees and the log odds below which a document goes; no trees: all stay."""

    trees: boosting.Trees | None
    least: float

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(counts, failed the fixed rules, log odds, kept)."""
        counts = measure(data, offsets)
        failed = base_failed(counts)
        odds = self.trees.margin(features(counts)) if self.trees else np.zeros(len(failed))
        return counts, failed, odds, ~failed & (odds >= self.least)


def counts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, COUNTS...) of each row; a null text has no words."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                counts = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("id")[low:high], *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["id", *COUNTS])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS))


def fit_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> Rules:
    """Trees fitted on at most ``most`` labelled documents, and a threshold from a held-out quarter.

    The sample is the labelled ids with the smallest hashes, the same at every size; its
    counts are all that reaches the driver. Rows without an id or label are not used. The
    trees judge what passes the fixed rules, so only that is learnt from. Without both
    labels among those rows there are no trees.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("good"))
    known = known.filter("id is not null and good is not null")
    chosen = hashed_share(known, "id", 2 * most).orderBy(F.xxhash64("id"), "id", "good").limit(most)
    chosen = chosen.groupBy("id").agg(F.max("good").alias("good"))
    texts = id_and_text(df, id_col, text_col).join(chosen.select("id"), "id", "left_semi")
    rows = counts_of(texts, "id", "text").join(chosen, "id").orderBy("id", *COUNTS).limit(2 * most).collect()
    counts = {c: np.array([r[c] for r in rows], np.int64) for c in COUNTS}
    x, y, ids = features(counts), np.array([r["good"] for r in rows]), np.array([r["id"] for r in rows], np.int64)
    able = ~base_failed(counts)
    x, y, ids = x[able], y[able], ids[able]
    held = boosting.split_fold(ids)
    if len(set(y[~held].tolist())) < 2 or not (y[held] == 1).any():
        return Rules(None, -np.inf)
    trees = boosting.fit(x[~held], y[~held], monotone=list(FEATURES.values()))
    good = np.sort(trees.margin(x[held & (y == 1)]))
    return Rules(trees, float(min(good[int(GOOD_LOST * len(good))], 0.0)) - 1e-9)


def judged(df: DataFrame, rules: Rules, id_col: str, text_col: str) -> DataFrame:
    """(id, COUNTS..., base_failed, log_odds, kept), one row for each row of ``df``.

    Rows are independent. Null and empty texts have no words, fail the fixed rules and
    are not kept; null and repeated ids stay on their rows; other columns are not read.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                counts, failed, odds, kept = rules.judge(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(odds), pa.array(kept)],
                    ["id", *COUNTS, "base_failed", "log_odds", "kept"],
                )

    schema = "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, log_odds double, kept boolean"
    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)


def keep_good(df: DataFrame, rules: Rules, text_col: str) -> DataFrame:
    """The rows that ``judged`` keeps, with the columns they came with."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            kept = [rules.judge(data, offsets)[3] for _low, _high, data, offsets in slices(column)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return df.mapInArrow(run, df.schema)
