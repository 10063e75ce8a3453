"""Texts decoded with the wrong character encoding: finding and restoring them (problem 3).

A smoothed character n-gram model is trained on the clean words of all records. Every
candidate chain of encode-decode steps is tried on a suspicious name and its result is
scored against the name as it stands; the likeliest chain is accepted if it is better by
more than a margin. The weights of the n-gram orders and the margin are not set by hand: the
records are parted into folds, whose words are judged by the counts of the other folds; the
weights are those under which held-out words are likeliest, and the margin is where garbled
and untouched held-out words are told apart with the fewest errors (see :func:`validate`). All
words take part, in every fold that they occur in and under every garbling, so the tasks judge
them and only sums reach the driver. Paths are judged component by component, because
often just one of them is garbled; a component that ends in the first half of a two-byte
character is also tried together with the next ones, as its second half may have become a
backslash.

The model is a table of hashed n-gram counts of fixed size, so what the driver gathers and
the tasks receive does not grow with the data.
"""

from __future__ import annotations

import codecs
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.runtime import cut_lineage

#: Buckets of the hashed n-gram counts.
BUCKETS = 1 << 19
#: Least gain of log-likelihood of an accepted chain where too few words could be held out to validate one
#: and of a letter lost at the end of a word, and what each step of a chain costs.
MARGIN, STEP_COST = 3.0, 1.0
#: Folds of the records, and least words for validating the margin.
FOLDS, LEAST_VALIDATED = 5, 50
#: Words that one task judges (a task judges fewer where there are too few for all cores).
TASK_WORDS = 2000
#: Margins that are tried.
MARGINS = tuple(m / 2 for m in range(0, 41))
#: Longest chain of wrong decodings that is undone.
MAX_STEPS = 3
#: Log-likelihood of a symbol at either end of a word, and what a word of mixed scripts costs.
EDGE, MIXED = -6.0, -10.0
#: Symbols that do stand at the ends of clean words.
EDGE_SYMBOLS = frozenset("¿¡«»“”„‘’‚‹›…–—•·™®©°§†‡€£¥½¼¾±×÷µªº№¹²³´¨¸")
#: Encodings under which bytes may have been misread, and encodings that they may have been in.
MISREAD_AS = ("cp1252*", "latin-1", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254*", "mac_roman", "cp866", "koi8-r", "iso8859-2", "iso8859-15")
#: The same for encodings of two-byte characters; tried on texts that have such characters.
MISREAD_AS_WIDE = ("cp932", "gbk", "cp949", "big5", "euc_jp")
REALLY = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp932", "euc_jp", "cp866", "koi8-r", "iso8859-2", "iso8859-7", "iso8859-9", "iso8859-5", "cp850", "cp437", "mac_roman", "gbk", "cp949")
#: Encodings with characters whose second byte may be a backslash.
WITH_BACKSLASH = ("cp932", "gbk", "cp949")
#: Fixed value: what splits a name into words for scoring (chains are applied to whole names).
SPLIT = r"[ _\-.,;()\[\]0-9\\]+"
_SPLIT = re.compile(SPLIT)
#: Fixed value: characters that no name has.
_UNLIKELY = re.compile("[\x00-\x1f\x7f-\x9f\ufffd]")
_DIGITS = re.compile(r"[0-9]+")
#: Fixed value: characters that hardly occur in clean names, for choosing what to train on.
DIRTY = r"[�?\u0080-¿×÷ƒˆ-˝‐-⯿-￰-￿\u0000-\u001f]"

_C1 = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {b: chr(b) for b in (0x8E, 0x9E)}


def _table(codec: str, holes: bool) -> tuple[dict[int, int], dict[int, str]]:
    to_byte: dict[int, int] = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            if not holes:
                continue
            ch = chr(b)  # undefined bytes usually come through as control characters
        to_byte[ord(ch)] = b
    return to_byte, {v: chr(k) for k, v in to_byte.items()}


_MAPS: dict[str, object] = {}


def encode(text: str, codec: str) -> bytes | None:
    """The bytes of a text under a one-byte encoding (``*``: with control characters for its holes)."""
    if codec in MISREAD_AS_WIDE or codec == "latin-1":
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    table = _MAPS.get(codec)
    if table is None:
        to_char = _table(codec.rstrip("*"), codec.endswith("*"))[1]
        table = _MAPS[codec] = codecs.charmap_build("".join(to_char.get(b, "\ufffe") for b in range(256)))
    try:
        return codecs.charmap_encode(text, "strict", table)[0]
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


def candidates(text: str) -> dict[tuple, str]:
    """Every text that undoing up to ``MAX_STEPS`` wrong decodings can give, by its chain."""
    out: dict[tuple, str] = {}
    seen = {text}
    front: list[tuple[tuple, str]] = [((), text)]
    for depth in range(MAX_STEPS):
        following: list[tuple[tuple, str]] = []
        for chain, t in front:
            bytes_of: dict[bytes, str] = {}
            wide = any(ord(ch) >= 0x2E80 for ch in t)
            for wrong in (*MISREAD_AS, *MISREAD_AS_WIDE) if wide else MISREAD_AS:
                data = encode(t, wrong)
                if data is not None and data not in bytes_of:
                    bytes_of[data] = wrong
            for data, wrong in bytes_of.items():
                fixed = _decode(data, "utf-8")
                if fixed is not None:
                    if fixed not in seen:
                        seen.add(fixed)
                        step = (*chain, (wrong, "utf-8"))
                        out[step] = fixed
                        following.append((step, fixed))
                    continue  # valid UTF-8 with such characters is no accident
                if depth == 0 or wrong in ("cp1252*", "latin-1"):
                    for really in REALLY:
                        fixed = _decode(data, really)
                        if fixed is not None and fixed != t:
                            out.setdefault((*chain, (wrong, really)), fixed)
            if depth == 0:
                for a, b in (("utf-16-le", "utf-16-be"), ("utf-16-le", "utf-8"), ("utf-16-be", "utf-8")):
                    data = t.encode(a, "surrogatepass")
                    fixed = _decode(data, b)
                    if fixed is not None and fixed != t and "\x00" not in fixed:
                        out[((a, b),)] = fixed
                if "\x00" in t:
                    for wrong in ("latin-1", "cp1252*"):
                        data = encode(t, wrong)
                        for really in ("utf-16-le", "utf-16-be"):
                            fixed = None if data is None or len(data) % 2 else _decode(data, really)
                            if fixed is not None:
                                out[((wrong, really),)] = fixed
        front = following
    return out


def gram_bucket(gram: str) -> int:
    """The bucket of an n-gram: the same as ``pmod(xxhash64(gram), BUCKETS)`` in Spark."""
    import xxhash

    value = xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"), seed=42)
    return (value - (1 << 64) if value >= 1 << 63 else value) % BUCKETS


_SCRIPTS = ((0x370, 0x3FF, 1), (0x400, 0x52F, 2), (0x3040, 0x30FF, 3), (0x3400, 0x9FFF, 3), (0xAC00, 0xD7AF, 4))


def _mixed(word: str) -> bool:
    """Whether a word has letters of more than one script."""
    seen = set()
    for ch in word:
        if ch.isalpha():
            o = ord(ch)
            seen.add(next((k for a, b, k in _SCRIPTS if a <= o <= b), 0 if o < 0x250 else 9))
    return len(seen) > 1


class Model:
    """Log-likelihoods of words by interpolated 1- to 3-grams with additive smoothing."""

    WEIGHTS = (0.70, 0.24, 0.059)

    def __init__(self, counts: np.ndarray, total: float, weights: tuple[float, float, float] = WEIGHTS, margin: float = MARGIN, room: float = 1.0):
        """``room``: share of the memory for what is remembered, where a worker has several models."""
        self.counts, self.total, self.weights, self.margin, self.room = counts, max(total, 1.0), weights, margin, room
        self._count: dict[str, float] = {}
        self._score: dict[str, float] = {}
        self._most: dict[str, float] = {}  # words of which only an upper bound was needed
        self.judged: dict[str, tuple[int, tuple, float]] = {}
        self.halves: dict[str, bool] = {}

    def count(self, gram: str) -> float:
        c = self._count.get(gram)
        if c is None:
            if len(self._count) > 500_000 * self.room:
                self._count.clear()
            c = self._count[gram] = float(self.counts[gram_bucket(gram)])
        return c

    def shares(self, t: str, i: int) -> tuple[float, float, float]:
        """The likelihoods of character ``i`` of ``t`` by itself, after one and after two characters."""
        one = self.count(t[i]) / self.total
        base = self.count(t[i - 1])
        two = self.count(t[i - 1 : i + 1]) / base if base else 0.0
        base = self.count(t[i - 2 : i]) if i > 1 else 0.0
        return one, two, self.count(t[i - 2 : i + 1]) / base if base else 0.0

    def score(self, word: str, least: float = -math.inf) -> float:
        """Log-likelihood of a word with its ends; letter case and digits do not matter.
        Once it is under ``least`` the rest is left out."""
        s = self._score.get(word)
        if s is not None:
            return s
        s = self._most.get(word)
        if s is not None and s < least:
            return s
        t = "\x02" + re.sub(r"\d+", "0", word.lower()) + "\x03"
        three, two, one = self.weights
        total = 0.0
        for i in range(1, len(t)):
            if i in (1, len(t) - 2) and t[i] in EDGE_SYMBOLS:
                total += EDGE
                continue
            a, b, c = self.shares(t, i)
            total += math.log(1e-7 + one * a + two * b + three * c)
            if total < least:
                if len(self._most) > 300_000 * self.room:
                    self._most.clear()
                self._most[word] = total
                return total
        if _mixed(word):
            total += MIXED
        if len(self._score) > 200_000 * self.room:
            self._score.clear()
        self._score[word] = total
        return total


def grams(word: Column) -> Column:
    """All 1-, 2- and 3-grams of a lower-case word with its ends."""
    t = F.concat(F.lit("\x02"), word, F.lit("\x03"))
    n = F.length(t)

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(t, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.concat(of(1), of(2), of(3))


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """The distinct words of letters beyond ASCII of all rows, without ``DIRTY`` characters: w, how
    often they occur (n), and how often in each fold (folds). Rows of one value are in one fold."""
    fold = F.pmod(F.xxhash64(F.col(column), F.lit(1)), F.lit(FOLDS))
    words = (
        values.where(F.col(column).rlike(r"[^\x00-\x7f]"))
        .select(F.explode(F.split(F.col(column), r"[\\\\/:]+|" + SPLIT)).alias("w"), fold.alias("fold"))
        .where(F.col("w").rlike(r"[^\x00-\x7f]") & ~F.col("w").rlike(DIRTY))
        .groupBy("w")
        .agg(F.count("*").alias("n"), *[F.count_if(F.col("fold") == k).alias(f"f{k}") for k in range(FOLDS)])
    )
    return words.select("w", "n", F.array(*[f"f{k}" for k in range(FOLDS)]).alias("folds"))


def clean_words(words: DataFrame) -> DataFrame:
    """The words of ``words`` (w, n) that no chain turns into one (or several) more than twice as frequent."""

    def expand(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pairs = [(w, f) for w in b.column(0).to_pylist() for t in set(candidates(w).values()) for f in _SPLIT.split(t) if len(f) > 1 and not f.isascii()]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([f for _, f in pairs], pa.string())], names=["w", "f"])

    other = words.select(F.col("w").alias("f"), F.col("n").alias("m"))
    likelier = words.select("w").mapInArrow(expand, "w string, f string").join(other, "f").groupBy("w").agg(F.max("m").alias("m"))
    return words.join(likelier, "w", "left").where(F.col("m").isNull() | (F.col("m") <= 2 * F.col("n"))).select(*words.columns)


def train(values: DataFrame, column: str) -> Model:
    """The model of the clean words with letters beyond ASCII of all rows, validated.

    A word is clean when it has no character that wrong decodings typically leave
    (``DIRTY``) and undoing a decoding gives no much more frequent word. The weights and the
    margin are found on all of them, with counts that leave the judged words out."""
    words = clean_words(cut_lineage(vocabulary(values, column)))
    words = cut_lineage(words.groupBy(F.lower("w").alias("w")).agg(F.array(*[F.sum(F.col("folds")[k]) for k in range(FOLDS)]).alias("folds")))
    one = F.length("gram") == 1
    counted = (
        words.select(F.explode(grams(F.col("w"))).alias("gram"), "folds")
        .groupBy(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        .agg(*[F.array(*[F.sum(F.when(test, F.col("folds")[k]).otherwise(0)) for k in range(FOLDS)]).alias(c) for c, test in (("counts", F.lit(True)), ("ones", one))])
    )
    tables, totals = np.zeros((FOLDS, BUCKETS), dtype=np.float32), np.zeros(FOLDS)
    for bucket, counts, ones in counted.collect():  # at most BUCKETS rows
        tables[:, bucket] = counts
        totals += ones
    weights, margin, _ = validate_all(tables, totals, words)
    return Model(tables.sum(axis=0), float(totals.sum()), weights, margin)


def likely_parts(shares: np.ndarray, often: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """What each n-gram order contributes to characters that occur ``often``, and how many these are:
    sums over rows of ``shares`` (highest order first)."""
    parts = shares * np.asarray(weights)
    parts /= parts.sum(axis=1, keepdims=True) + 1e-7
    return np.append((parts * often[:, None]).sum(axis=0), often.sum())


def fit_weights(parts_under: Callable[[Sequence[float]], np.ndarray], rounds: int = 12) -> tuple[float, float, float]:
    """The weights of the n-gram orders under which characters are likeliest (expectation maximisation),
    given :func:`likely_parts` of all characters as a function of the weights."""
    weights = np.array(Model.WEIGHTS)
    for _ in range(rounds):
        parts = parts_under(weights)
        if not parts[-1]:
            return Model.WEIGHTS
        weights = np.maximum(parts[:-1] / parts[-1], 0.01)
        weights /= weights.sum() * 1.001
    return tuple(round(float(w), 9) for w in weights)  # sums of many tasks differ in the last digits


def garbled_forms(word: str) -> list[str]:
    """Every text that one wrong decoding makes of ``word``, without control characters."""
    made: dict[str, None] = {}
    for really in ("utf-8", *REALLY):
        try:
            data = word.encode(really)
        except UnicodeEncodeError:
            continue
        for wrong in MISREAD_AS:
            table = _TABLES_BACK.get(wrong) or _TABLES_BACK.setdefault(wrong, _table(wrong.rstrip("*"), wrong.endswith("*"))[1])
            if all(b in table for b in data):
                text = "".join(table[b] for b in data)
                if text != word and not _UNLIKELY.search(text.translate(_HOLES)):
                    made[text] = None
    return list(made)


_TABLES_BACK: dict[str, dict[int, str]] = {}
#: Fixed value: the control characters that stand for bytes some encodings do not define.
_HOLES = {ord(ch): None for ch in _C1.values()}


def fold_models(tables: np.ndarray, totals: np.ndarray, weights: tuple[float, float, float] = Model.WEIGHTS) -> list[Model]:
    """For each fold the model of all others, without a margin."""
    counts, total = tables.sum(axis=0), totals.sum()
    return [Model(counts - tables[k], float(total - totals[k]), weights, 0.0, 1 / FOLDS) for k in range(FOLDS)]


def held_out_shares(models: Sequence[Model], words: Iterable[tuple[str, Sequence[int]]]) -> np.ndarray:
    """One row per character of a word and fold that it occurs in: its likelihoods by the counts of the
    other folds, highest order first, and its occurrences."""
    rows = []
    for w, folds in words:
        t = "\x02" + re.sub(r"\d+", "0", w) + "\x03"
        rows += [(*reversed(models[k].shares(t, i)), n) for k, n in enumerate(folds) if n for i in range(1, len(t))]
    return np.array(rows, dtype=float).reshape(-1, 4)


def held_out_errors(models: Sequence[Model], words: Iterable[tuple[str, Sequence[int]]]) -> np.ndarray:
    """Occurrences of words untouched and garbled, then for each margin those that are untouched and
    taken for garbled, garbled and missed, and garbled and restored wrongly."""
    margins, judged, errors = np.array(MARGINS), np.zeros(2), np.zeros((3, len(MARGINS)))
    for w, folds in words:
        made = garbled_forms(w)
        for text in (w, *made):
            forms = undone(text)
            for k, n in enumerate(folds):
                if not n:
                    continue
                gain, fixed, _ = choose(models[k], text, forms=forms)
                if text == w:
                    judged[0] += n
                    errors[0] += n * (gain > margins)
                else:
                    judged[1] += n / len(made)
                    errors[1] += n / len(made) * (gain <= margins)
                    if fixed.lower() != w:
                        errors[2] += n / len(made) * (gain > margins)
    return np.concatenate([judged, errors.ravel()])


def best_margin(sums: np.ndarray) -> tuple[float, list[tuple[float, float, float, float]]]:
    """(margin, curve) from the sums of :func:`held_out_errors`."""
    untouched, garbled = (float(n) or 1.0 for n in sums[:2])
    wrong = sums[2:].reshape(3, -1) / np.array([[untouched], [garbled], [garbled]])
    curve = [(m, *map(float, c)) for m, c in zip(MARGINS, wrong.T)]
    errors = [round(sum(c[1:]), 9) for c in curve]
    best = [c[0] for c, e in zip(curve, errors) if e == min(errors)]
    return best[len(best) // 2], curve


def validate(tables: np.ndarray, totals: np.ndarray, words: Sequence[tuple[str, Sequence[int]]]) -> tuple[tuple[float, float, float], float, list[tuple[float, float, float, float]]]:
    """(weights, margin, curve) from the counts of each fold and words with their occurrences in each fold.

    Each word is judged as it stands, and garbled by every single chain, for each fold that
    it occurs in with the counts of all others. ``curve`` gives for each margin the shares of
    occurrences that are untouched and taken for garbled, garbled and missed, and garbled
    and restored wrongly; the margin is the middle of those with the fewest errors
    together. Of fewer than ``LEAST_VALIDATED`` words nothing is validated: ``MARGIN``."""
    if len(words) < LEAST_VALIDATED:
        return Model.WEIGHTS, MARGIN, []
    rows = held_out_shares(fold_models(tables, totals), words)
    weights = fit_weights(lambda w: likely_parts(rows[:, :3], rows[:, 3], w))
    return weights, *best_margin(held_out_errors(fold_models(tables, totals, weights), words))


def validate_all(tables: np.ndarray, totals: np.ndarray, words: DataFrame) -> tuple[tuple[float, float, float], float, list[tuple[float, float, float, float]]]:
    """:func:`validate` for all rows of ``words`` (w, folds) at once, judged by the tasks."""
    n = words.count()
    if n < LEAST_VALIDATED:
        return Model.WEIGHTS, MARGIN, []
    context = words.sparkSession.sparkContext
    held = context.broadcast((tables, totals))

    def rows_of(batches: Iterable) -> Iterator[tuple[str, Sequence[int]]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

    def shares(batches: Iterable) -> Iterator:
        import pyarrow as pa

        models = fold_models(*held.value)
        for b in batches:
            rows = held_out_shares(models, rows_of([b]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=["three", "two", "one", "n"])

    tasks = 1 + n // TASK_WORDS
    rows = cut_lineage(words.select("w", "folds").repartition(tasks, "w").mapInArrow(shares, "three double, two double, one double, n double"))

    def parts_under(weights: Sequence[float]) -> np.ndarray:
        def parts(batches: Iterable) -> Iterator:
            total = np.zeros(4)
            for b in batches:
                columns = [c.to_numpy() for c in b.columns]
                total += likely_parts(np.stack(columns[:3], axis=1), columns[3], weights)
            yield _sums(total)

        return _summed(rows.mapInArrow(parts, "sums array<double>"))

    weights = fit_weights(parts_under)

    def errors(batches: Iterable) -> Iterator:
        yield _sums(held_out_errors(fold_models(*held.value, weights), rows_of(batches)))

    spread = words.select("w", "folds").repartition(max(tasks, context.defaultParallelism), "w")
    sums = _summed(spread.mapInArrow(errors, "sums array<double>"))
    held.destroy()
    return weights, *best_margin(sums)


def _sums(values: np.ndarray):
    """An Arrow batch of one row that holds sums of a task."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([values.tolist()], pa.list_(pa.float64()))], names=["sums"])


def _summed(sums: DataFrame) -> np.ndarray:
    """The totals of the rows of sums, one from each task."""
    return np.array([r[0] for r in sums.collect()]).sum(axis=0)


CLEAN, RESTORED, LOST = 0, 1, 2
_LETTER = re.compile(r"[^\W\d_]")


def _lost_letters(model: Model, component: str) -> bool:
    """Whether a question mark stands for a lost letter."""
    if "?" not in component:
        return False
    for m in re.finditer(r"[^\W\d_?]*\?[^\W\d_]*(?:\?+[^\W\d_]*)*", component):
        word = m.group()
        body = word.rstrip("?")
        if not body:
            if len(word) > 1 or component.strip("?") == "":
                return True
            continue
        if body.startswith("?") or "?" in body:
            return True  # before or between letters
        if component[: m.start()].endswith("¿"):
            continue
        tail = len(word) - len(body)
        if tail > 1:
            return True
        plain = model.score(body)
        filled = max(model.score(body + ch) for ch in "áàâãäåæçéèêëíìîïñóòôõöøúùûüýÿąćęłńśźżčďěňřšťůžşğı")
        if filled > -4.0 * (len(body) + 2) and filled > plain + MARGIN:  # the model's margin is validated for chains alone
            return True
    return False


def apply_chain(text: str, chain: tuple) -> str | None:
    """The result of undoing a chain of wrong decodings; None where it does not apply."""
    for wrong, really in chain:
        data = text.encode(wrong, "surrogatepass") if wrong.startswith("utf-16") else encode(text, wrong)
        text = None if data is None else _decode(data, really)
        if text is None:
            return None
    return text


def repair_component(model: Model, component: str) -> tuple[int, str, float]:
    """(CLEAN, itself), (RESTORED, original) or (LOST, "") for one path component or name, and the gain."""
    if component.isascii() and "?" not in component:
        return CLEAN, component, 0.0
    # ASCII digits come through every chain of one- and two-byte encodings and do not matter to scores,
    # so names that differ in them alone share the verdict and the chain
    key = _DIGITS.sub("0", component)
    known = model.judged.get(key)
    if known is None:
        if len(model.judged) > 100_000:
            model.judged.clear()
        known = model.judged[key] = _judge(model, key)
    status, chain, gain = known
    if status == RESTORED:
        text = None if any(wrong.startswith("utf-16") or really.startswith("utf-16") for wrong, really in chain) else apply_chain(component, chain)
        if text is None:
            status, chain, gain = _judge(model, component)
            text = apply_chain(component, chain) if status == RESTORED else component
        return status, text, gain
    return status, component if status == CLEAN else "", gain


def _judge(model: Model, component: str) -> tuple[int, tuple, float]:
    """(status, chain, gain) of a component."""
    if "\ufffd" in component or _lost_letters(model, component):
        return LOST, (), 0.0
    if component.isascii():
        return CLEAN, (), 0.0
    gain, _, chain = choose(model, component)
    return (RESTORED, chain, gain) if gain > 0 else (CLEAN, (), 0.0)


def _half_character(part: str) -> bool:
    """Whether a component may end in the first half of a two-byte character whose second is a
    backslash: its bytes, as misread in some encoding and perhaps again as UTF-8, do not
    decode, but do with a backslash behind them."""
    forms, front = {part}, [part]
    for _ in range(MAX_STEPS - 1):
        undone = {t for f in front for wrong in MISREAD_AS if (data := encode(f, wrong)) is not None and (t := _decode(data, "utf-8")) is not None}
        front = list(undone - forms)
        forms |= undone
    for form in forms:
        for data in {encode(form, wrong) for wrong in MISREAD_AS}:
            if data and data[-1] >= 0x81 and any(_decode(data, really) is None and _decode(data + b"\\", really) is not None for really in WITH_BACKSLASH):
                return True
    return False


def may_go_on(model: Model, part: str) -> bool:
    """:func:`_half_character`, remembered for names that differ in digits alone."""
    key = _DIGITS.sub("0", part)
    known = model.halves.get(key)
    if known is None:
        if len(model.halves) > 100_000:
            model.halves.clear()
        known = model.halves[key] = _half_character(key)
    return known


def whole_score(model: Model, text: str, least: float = -math.inf) -> float:
    """Log-likelihood of a name by its words with characters beyond ASCII; others are told by any model."""
    total = 0.0
    for w in _SPLIT.split(text):
        if not w.isascii():
            total += model.score(w, least - total)
            if total < least:
                break
    return total


def undone(text: str, two_byte: bool = False) -> dict[str, tuple]:
    """The shortest chain to each text that undoing wrong decodings can give and that may be a name.
    ``two_byte`` allows only chains into encodings whose characters may hold a backslash."""
    forms: dict[str, tuple] = {}
    for chain, fixed in candidates(text).items():
        if two_byte and chain[-1][1] not in WITH_BACKSLASH:
            continue
        if fixed not in forms and not _UNLIKELY.search(fixed):
            forms[fixed] = chain  # chains come shortest first
    return forms


def choose(model: Model, text: str, two_byte: bool = False, forms: dict[str, tuple] | None = None) -> tuple[float, str, tuple]:
    """(gain beyond the margin, result, chain) of the likeliest chain; a gain of 0 or less: leave it.
    ``forms``: what :func:`undone` gives, where it is known."""
    # a word of one or two symbols (such as a ruler) speaks neither for nor against
    base = sum(
        model.score(w)
        for w in _SPLIT.split(text)
        if len(w) > 1 and not w.isascii() and (len(set(w)) > 2 or any(ch.isalpha() or "\x7f" < ch < "\xa0" for ch in w))
    )
    gain, out, best = 0.0, text, ()
    for fixed, chain in (undone(text, two_byte) if forms is None else forms).items():
        cost = base + model.margin + STEP_COST * len(chain)
        g = whole_score(model, fixed, cost + gain) - cost
        if g > gain:
            gain, out, best = g, fixed, chain
    return gain, out, best


def repair(model: Model, value: str | None) -> tuple[int, str]:
    """The verdict on a whole name or path. A null or empty value is clean."""
    if not value or (value.isascii() and "?" not in value):
        return CLEAN, value or ""
    lead = re.match(r"(?:\\\?\?\\)?(?:\\\\\?\\)?", value).group()
    parts = value[len(lead) :].split("\\")
    status, behind, gone = CLEAN, 0, False
    for i in [i for i, part in enumerate(parts) if not part.isascii() or "?" in part]:
        if i < behind:
            continue
        part = parts[i]
        got, text, apart = repair_component(model, part)
        took = 1
        if i + 1 < len(parts) and not part.isascii() and got != LOST:
            gain = 0.0
            for k in range(2, len(parts) - i + 1):  # a backslash may be half of a character
                if not may_go_on(model, parts[i + k - 2]):
                    break
                apart += repair_component(model, parts[i + k - 1])[2]
                g, t, _ = choose(model, "\\".join(parts[i : i + k]), True)
                if g - apart > gain and t.count("\\") < k - 1:
                    got, text, took, gain = RESTORED, t, k, g - apart
        if got == LOST:
            return LOST, ""
        status = max(status, got)
        behind = i + took
        parts[i] = text
        for j in range(i + 1, behind):
            parts[j] = None
            gone = True
    return status, lead + "\\".join([p for p in parts if p is not None] if gone else parts)


def find_garbled(values: DataFrame, column: str, keep: Sequence[str], model: Model | None = None) -> DataFrame:
    """The rows whose ``column`` was decoded wrongly or lost letters, with ``restored``.

    ``restored`` is the whole original value, or the empty text where characters are lost
    beyond restoring. Nulls, empty and clean values give no row; repeated rows give their
    row again; ``keep`` names the columns to return.
    Without ``model`` one is trained on all of ``values``."""
    model = train(values, column) if model is None else model
    held = values.sparkSession.sparkContext.broadcast((model.counts, model.total, model.weights, model.margin))
    suspicious = F.col(column).rlike(r"[^\x00-\x7f]") | F.regexp_replace(F.col(column), r"^(\\\?\?\\)?(\\\\\?\\)?", "").contains("?")
    picked = values.where(suspicious).select(*keep, column)
    names, token = list(keep), uuid.uuid4().hex

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        own = _model(held, token)
        for b in batches:
            rows, restored = [], []
            for i, value in enumerate(b.column(len(names)).to_pylist()):
                status, text = repair(own, value)
                if status != CLEAN:
                    rows.append(i)
                    restored.append(text)
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(names)], pa.array(restored, pa.string())], names=[*names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(names)])
    return picked.mapInArrow(run, f"{fields}, restored string")


_MODELS: dict[str, Model] = {}


def _model(held, token: str) -> Model:
    """The worker's model, built once from the broadcast counts and kept with its verdicts."""
    if token not in _MODELS:
        _MODELS.clear()
        _MODELS[token] = Model(*held.value)
    return _MODELS[token]
