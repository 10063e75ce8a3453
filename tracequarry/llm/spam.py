"""Keyword-stuffed and link-list pages (problem 9).

1. Over all documents the core words of each language's prose are found: words that a
   third of its documents use and other languages do not, without the corpus's subject
   words, which some pages repeat far beyond what sentences do.
2. For every page the terms are counted. SQL windows over the frequency spectrum give each
   term its rank; a weighted least-squares fit of log frequency on log rank gives the
   curve's slope and residual, and the share of core words its divergence from prose.
3. Pages are compared with those of the same language and of comparable length: an extreme
   slope, residual or divergence (robust z-score) flags a page.
4. An exact check of the flagged pages measures which part is keywords, links or tags rather
   than sentences or technical lists, as logs, indicator lists and rules have curves unlike
   prose, too. Pages that no curve flags are never spam and are not read again. Whether
   sentences that carry a few words over and over are meant for search is decided by the
   page's curve: only one far steeper than comparable prose, or far from it, makes them count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracequarry.runtime import cut_lineage

#: Share of a language's documents that use a core word, and how many times the share in other languages that must be.
CORE_SHARE, CORE_RATIO = 0.33, 3.0
#: Least documents of a language for core words of its own.
LANGUAGE_DOCUMENTS = 20
#: Share of core words among a page's words from which others are compared with it.
PROSE_SHARE = 0.36
#: A word that makes such a share of a page of so many words at least, in such a share of its documents, is a subject word.
SUBJECT_SHARE, SUBJECT_WORDS, SUBJECT_DOCUMENTS = 0.15, 20, 0.005
#: Most words a task counts before it passes its counts on.
HELD_WORDS = 200_000
#: Robust z-scores from which a slope, residual or divergence is extreme.
EXTREME_CURVE, EXTREME_DIVERGENCE = 4.0, 2.0
#: Share of a paragraph's words that its three most frequent keywords must have for its sentences to count as stuffed.
#: (The second value is for texts without blanks between words, whose stretches repeat more.)
DOMINANCE, DOMINANCE_UNSPACED = 0.33, 0.42
#: Robust z-scores of a page's slope and divergence from which such sentences do count.
STEEP, DIVERGENT = -7.0, 6.0
#: Share of a language's documents from which a core word is never a keyword.
FUNCTION_SHARE = 0.5
#: Most languages whose quantiles (some 20 rows each) are broadcast; with more the optimiser chooses the join.
BROADCAST_LANGUAGES = 5_000
#: Part of a page that must be keywords, links or tags.
GREATER_PART = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]]+")
_PRICE = re.compile(r"[$€£¥]\s?\d|\b(?:USD|EUR|GBP|SKU)\b")
_TAG = re.compile(r"[#＃]\w+")
_HTML = re.compile(r"<[^<>]{0,400}>")
_SENTENCES = re.compile(r"(?<=[.!?。！？])\s+")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
#: What log lines, indicator lists, paths, software lists, rules and dumps consist of.
_TECHNICAL = re.compile(
    r"[A-Za-z]:\\|\bHK[A-Z]{2}\\|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-fA-F]{16,}\b|\b\d\d:\d\d\b|\b\d+\.\d+\.\d+\b|[{}\[]\"|\"\s*:"
    r"|\b[A-Z]{2,6}-[A-Z]+\d+\b|\b\w+\.(?:bat|exe|dll|sys|msi|ps1|scr|txt|csv|log|pdf|docx|xlsx|png|lnk|tmp|zip|html|evtx|hve|dat)\b"
    r"|^\s*- '|\b\d{4}-\d\d-\d\d\b"
)
_LABEL = re.compile(r"\s*(?:- )?[A-Za-z_|]+:(?:\s+|$)")
#: Letters that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧ013$@", "aeopcyxijsdhlqwabezhikmnoptyxolesa")


def _count_words(batches: Iterable) -> Iterator:
    """For each language and word of (language, text) rows: the documents that use it and those it is heavy in."""
    import pyarrow as pa

    used: dict[str, Counter] = {}
    heavy: Counter = Counter()

    def flush():
        rows = [(lang, w, n, heavy[lang, w]) for lang, counts in used.items() for w, n in counts.items()]
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["l", "w", "n", "heavy"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts = Counter(_WORD.findall(text.lower()))
            used.setdefault(lang, Counter()).update(counts.keys())
            n = sum(counts.values())
            if n >= SUBJECT_WORDS:
                heavy.update((lang, w) for w, c in counts.items() if c >= SUBJECT_SHARE * n)
            if sum(map(len, used.values())) >= HELD_WORDS:
                yield flush()
                used.clear()
                heavy.clear()
    yield flush()


def core_words(documents: DataFrame, text: str = "text", language: str = "lang") -> dict[str, dict[str, float]]:
    """Each language's core words with the share of its documents that use them.

    Document counts over all rows; only words that a share of ``CORE_SHARE`` uses come to
    the driver, which bounds them by the average page's vocabulary over that share."""
    rows = documents.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    # the primary subtag: two or three letters, so that there are at most 26^2 + 26^3 languages
    tag = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(language), F.lit("")))), r"^([a-z]{2,3})(?![a-z])", 1)
    rows = rows.select(tag.alias("l"), F.col(text).alias("t")).where(~F.col("l").isin("", "und"))
    sizes = {r[0]: r[1] for r in rows.groupBy("l").count().where(F.col("count") >= LANGUAGE_DOCUMENTS).collect()}
    if not sizes:
        return {}
    words = rows.mapInArrow(_count_words, "l string, w string, n bigint, heavy bigint")
    least = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, CORE_SHARE * v / CORE_RATIO)])
    common = words.groupBy("l", "w").agg(F.sum("n").alias("n"), F.sum("heavy").alias("heavy")).where(F.col("n") >= F.element_at(least, F.col("l"))).collect()
    shares: dict[str, dict[str, float]] = {}
    subjects: set[tuple[str, str]] = set()
    for lang, w, n, heavy in common:
        shares.setdefault(w, {})[lang] = n / sizes[lang]
        if n < FUNCTION_SHARE * sizes[lang] and heavy >= SUBJECT_DOCUMENTS * n:
            subjects.add((lang, w))
    out: dict[str, dict[str, float]] = {k: {} for k in sizes}
    for w, by in shares.items():
        for lang, share in by.items():
            rest = sorted(by.get(o, 0.0) for o in sizes if o != lang)
            typical = rest[len(rest) // 2] if rest else 0.0
            if share >= CORE_SHARE and share >= CORE_RATIO * typical and (lang, w) not in subjects:
                out[lang][w] = share
    return {k: v for k, v in out.items() if v}


def find_links(text: str) -> list[str]:
    return _URL.findall(text) if "http" in text or "www." in text else []


def find_tags(text: str) -> list[str]:
    return _TAG.findall(text) if "#" in text or "＃" in text else []


@lru_cache(maxsize=100_000)
def fold(word: str) -> str:
    """A word in one letter case, without invisible characters and with look-alikes of Latin letters replaced."""
    bare = _INVISIBLE.sub("", unicodedata.normalize("NFKC", word)).casefold()
    return bare.translate(_LOOKALIKES) if any("a" <= ch <= "z" for ch in bare) else bare


class Judge:
    """The page measures, for given core words of each language."""

    def __init__(self, core: dict[str, dict[str, float]]):
        self.languages = sorted(core)
        self.of: dict[str, tuple[int, ...]] = {}
        self.function = {w for words in core.values() for w, share in words.items() if share >= FUNCTION_SHARE}
        for i, lang in enumerate(self.languages):
            for w in core[lang]:
                self.of[w] = (*self.of.get(w, ()), i)

    def core_counts(self, counts: Counter) -> list[int]:
        out = [0] * max(1, len(self.languages))
        for w, n in counts.items():
            for i in self.of.get(w, ()):
                out[i] += n
        return out

    def terms(self, text: str) -> Counter:
        """Term counts: words, and links and tags as terms of their own."""
        links = find_links(text)
        bare = _URL.sub(" ", text) if links else text
        tags = find_tags(bare)
        if tags:
            bare = _TAG.sub(" ", bare)
        words = Counter(_WORD.findall(bare.lower()))
        if links:
            words["\x01link"] = len(links)
        if tags:
            words["\x01tag"] = len(tags)
        return words

    def measure(self, text: str) -> tuple[str, int, float, list[tuple[int, int]]]:
        """(language, number of terms, share of core words, spectrum) of a page."""
        counts = self.terms(text)
        total = sum(counts.values())
        core = self.core_counts(counts)
        best = max(range(len(core)), key=lambda i: core[i])
        share = core[best] / total if total else 0.0
        spectrum = sorted(Counter(counts.values()).items(), reverse=True)
        lang = self.languages[best] if self.languages and core[best] else ""
        return lang, total, share, spectrum

    def _kind(self, line: str) -> str:
        bare = line if line.isascii() else _INVISIBLE.sub("", line)
        links = len(find_links(bare))
        rest = _URL.sub(" ", bare) if links else bare
        tags = len(find_tags(rest))
        rest = _HTML.sub(" ", _TAG.sub(" ", rest)) if "<" in rest or tags else rest
        label = _LABEL.match(rest)
        if label:  # a field of a record if it holds a value; a list or a sentence behind a label is judged by itself
            rest = rest[label.end() :]
            if not links and not tags and len(_WORD.findall(rest)) < 4:
                return "technical"
        if _TECHNICAL.search(rest):
            return "technical"
        words = _WORD.findall(rest.lower())
        if len(words) >= 4 and not (len(words) < 16 and _PRICE.search(rest)):
            seen = Counter(words)
            core = max(self.core_counts(seen))
            kinds = max(self.core_counts(Counter(seen.keys())))
            if core >= 0.2 * len(words) and (kinds >= 2 or not self.function.isdisjoint(seen)) and max((c for w, c in seen.items() if w not in self.function), default=0) <= max(2, 0.2 * len(words)):
                return "prose"
        return "link" if links or tags else "keyword"

    def spam_part(self, text: str, steep: bool = True) -> float:
        """The part of a page (by characters) that is links, tags or repeated keywords; 0 without repetition.

        Sentences stuffed with keywords are part of it where the page's curve is ``steep`` or divergent."""
        links = len(find_links(text))
        tags = len(find_tags(_URL.sub(" ", text) if links else text))
        sizes: Counter = Counter()
        repeated: Counter = Counter()
        for paragraph in text.split("\n\n"):
            said: Counter = Counter()
            prose = 0
            for line in paragraph.split("\n"):
                for piece in _SENTENCES.split(line) if len(line) > 200 else (line,):
                    bare = piece.strip()
                    if not bare:
                        continue
                    kind = self._kind(bare)
                    if kind == "prose":
                        prose += len(bare)
                        said.update(fold(w) for w in _WORD.findall(bare))
                        continue
                    sizes[kind] += len(bare)
                    if kind == "keyword":
                        repeated.update(fold(w) for w in _WORD.findall(_HTML.sub(" ", bare)))
            n = sum(said.values())
            top = sorted((c for w, c in said.items() if c >= 3 and len(w) > 1 and w not in self.function), reverse=True)[:3]
            unspaced = 3 * sum(1 for ch in paragraph if "\u3040" <= ch <= "\u9fff") > len(paragraph)
            # sentences that only carry a few keywords, over and over
            sizes["stuffed" if steep and n >= 12 and sum(top) >= (DOMINANCE_UNSPACED if unspaced else DOMINANCE) * n else "prose"] += prose
        total = sum(sizes.values())
        if not total:
            return 0.0
        n = sum(repeated.values())
        keywords = n > 0 and sum(c for c in repeated.values() if c >= 3) >= 0.4 * n
        spam = sizes["stuffed"] + (sizes["link"] if links + tags >= 3 else 0)
        if keywords or spam > sizes["keyword"]:
            spam += sizes["keyword"]
        return spam / total


def measure_pages(documents: DataFrame, core: dict[str, dict[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per page: key, language, n_terms, core_share, spectrum (n: frequency, m: terms of it)."""
    held = documents.sparkSession.sparkContext.broadcast(core)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        judge = Judge(held.value)
        kinds = pa.list_(pa.struct([("n", pa.int32()), ("m", pa.int32())]))
        for b in batches:
            got = [judge.measure(t) for t in b.column(1).to_pylist()]
            spectra = pa.array([[{"n": n, "m": m} for n, m in g[3]] for g in got], kinds)
            columns = [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.float64()), spectra]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "language", "n_terms", "core_share", "spectrum"])

    rows = documents.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != "")).select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, language string, n_terms int, core_share double, spectrum array<struct<n:int,m:int>>")


def spam_parts(texts: DataFrame, core: dict[str, dict[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and spam_part of every page of ``texts`` (key, text, steep)."""
    held = texts.sparkSession.sparkContext.broadcast(core)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        judge = Judge(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([judge.spam_part(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.float64())], names=[key, "spam_part"])

    rows = texts.select(key, text, "steep")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, spam_part double")


def rank_curves(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds slope and residual of each page's rank-frequency curve.

    Terms of one frequency share a stretch of ranks; a window over the frequencies gives its
    ends, and the fit weighs the stretch's middle (in logarithms) by the number of terms."""
    points = pages.select(key, "language", "n_terms", "core_share", F.explode("spectrum").alias("s"))
    w = W.partitionBy(key).orderBy(F.desc("s.n")).rowsBetween(W.unboundedPreceding, 0)
    ranked = points.withColumn("last", F.sum("s.m").over(w)).withColumn("first", F.col("last") - F.col("s.m") + 1)
    m = F.col("s.m").cast("double")
    x = (F.log("first") + F.log("last")) / 2
    y = F.log(F.col("s.n"))
    sums = ranked.groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("language", "n_terms", "core_share")],
        F.sum(m).alias("sw"), F.sum(m * x).alias("sx"), F.sum(m * y).alias("sy"), F.sum(m * x * x).alias("sxx"), F.sum(m * x * y).alias("sxy"), F.sum(m * y * y).alias("syy"),
    )
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    slope = F.when(vx > 1e-9, cxy / vx).otherwise(0.0)
    rest = F.greatest(vy - F.when(vx > 1e-9, cxy * cxy / vx).otherwise(0.0), F.lit(0.0))
    return sums.select(key, "language", "n_terms", "core_share", slope.alias("slope"), F.sqrt(rest / F.col("sw")).alias("residual"))


def flagged_pages(documents: DataFrame, core: dict[str, dict[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every page with text: its curve, its z-scores against comparable prose and whether one is extreme (``flagged``).

    Prose is compared by language and length (powers of two of the number of terms). A page
    without a known language, or in a language without prose of its length, is compared with
    the prose of all languages; without any prose of that length it is flagged."""
    pages = cut_lineage(rank_curves(measure_pages(documents, core, key, text), key))
    pages = pages.withColumn("divergence", -F.log(F.col("core_share") + 0.02)).withColumn("bucket", F.floor(F.log2(F.greatest(F.col("n_terms"), F.lit(1)))).cast("int"))
    measures = ("slope", "residual", "divergence")
    prose = pages.where(F.col("core_share") >= PROSE_SHARE)
    # one row per known language (see core_words for their number) and power of two: small whatever the number of pages
    own = prose.groupBy("language", "bucket").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q_{c}") for c in measures])
    pooled = prose.groupBy("bucket").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"p_{c}") for c in measures])
    if len(core) <= BROADCAST_LANGUAGES:
        own = F.broadcast(own)
    joined = pages.join(own, ["language", "bucket"], "left").join(F.broadcast(pooled), "bucket", "left")
    for c in measures:
        q = F.coalesce(f"q_{c}", f"p_{c}")
        spread = F.greatest((q[2] - q[0]) / 1.349, F.lit(0.02))
        joined = joined.withColumn(f"z_{c}", (F.col(c) - q[1]) / spread)
    extreme = F.coalesce((F.abs("z_slope") >= EXTREME_CURVE) | (F.abs("z_residual") >= EXTREME_CURVE) | (F.col("z_divergence") >= EXTREME_DIVERGENCE), F.lit(True))
    return joined.select(key, "language", "n_terms", "core_share", "slope", "residual", "z_slope", "z_residual", "z_divergence", extreme.alias("flagged"))


def judged_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """The flagged pages (see :func:`flagged_pages`), with their ``spam_part`` and the verdict ``spam``.

    Null, empty and blank texts give no row and are no spam; repeated texts are judged
    alike, and repeated rows of one key give one row; the language tag is only used to learn
    core words, so wrong or missing tags do no harm; in a language of fewer than
    ``LANGUAGE_DOCUMENTS`` pages no line can be known as a sentence, so there repetition and
    the curve alone decide; an empty table gives no rows.
    """
    core = core_words(documents, text, language)
    flagged = flagged_pages(documents, core, key, text).where("flagged")
    steep = flagged.groupBy(key).agg(F.max(F.coalesce((F.col("z_slope") <= STEEP) | (F.col("z_divergence") >= DIVERGENT), F.lit(True))).alias("steep"))
    texts = documents.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != "")).select(key, text).join(steep, key)
    parts = spam_parts(texts, core, key, text).groupBy(key).agg(F.max("spam_part").alias("spam_part"))
    return flagged.dropDuplicates([key]).join(parts, key).withColumn("spam", F.col("spam_part") > GREATER_PART)


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """The keys of spam pages; see :func:`judged_pages` for the cases."""
    return judged_pages(documents, key, text, language).where("spam").select(key)
