"""Results as files: JSON arrays, JSON Lines, YAML-like dumps, CSV, records of hits, and tables for display."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.forensic import collapse, rfc3339
from tracequarry.rules.parse import Rule


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact document per line, in as many files as there are partitions."""
    df.select(as_json(df).alias("value")).write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One JSON array in one file: ``[``, the documents with commas between them, ``]``.

    An array is one file and so one task, which passes the rows on as they come; for results
    of any size :func:`write_jsonl` writes in parallel. ``order``: columns to sort by."""
    rows = df.orderBy(*order) if order else df

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held, opened = None, False
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                if text is None:
                    continue
                if held is not None:
                    out.append(("" if opened else "[") + held + ",")
                    opened = True
                held = text
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if held is None else ("" if opened else "[") + held + "]"])], names=["value"])

    # a null row, so that there is a task even where there are no rows
    text = rows.select(as_json(rows).alias("value")).union(df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value")))
    text.coalesce(1).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_yaml(df: DataFrame, path: str) -> None:
    """``---`` and the pretty document, for each row."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"})
    df.select(F.concat(F.lit("---\n"), text).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_log(df: DataFrame, path: str, columns: Sequence[str] = ("hit_ts", "hunt", "rule", "source")) -> None:
    """One line per row: the columns that there are, with tabs between them."""
    shown = [collapse(F.col(c).cast("string")) for c in columns if c in df.columns]
    df.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in shown]).alias("value")).write.mode("overwrite").text(path)


def cached(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks for results that are used several times."""
    return df.persist(StorageLevel.DISK_ONLY)


def hit_records(hits: DataFrame, document: Sequence[str], timestamp: str, rules: Sequence[Rule] = ()) -> DataFrame:
    """Hits as records: group, timestamp, name, authors, level, status, kind, document.

    Hits of :func:`aggregate_documents` (with ``key`` and ``n_docs``) become one record per
    document of a group, of kind ``aggregate``, with the group's key, number of documents
    and earliest time. Authors come from ``rules``, as a literal map."""
    authors = F.array().cast("array<string>")
    named = {r.name: list(r.authors) for r in rules if r.authors}
    if named:
        pairs = [x for k, v in named.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
        authors = F.coalesce(F.element_at(F.create_map(*pairs), F.col("rule")), authors)
    grouped = {"key", "n_docs", "first_seen"} <= set(hits.columns)
    ts = F.col("first_seen" if grouped else timestamp)
    when = rfc3339(ts) if dict(hits.dtypes)["first_seen" if grouped else timestamp].startswith("timestamp") else ts
    extra = [F.col("key").alias("group_key"), "n_docs"] if grouped else []
    return hits.select(
        F.col("hunt").alias("group"), when.alias("timestamp"), F.col("rule").alias("name"), authors.alias("authors"), "level", "status",
        F.lit("aggregate" if grouped else "individual").alias("kind"), *extra, F.struct(*[F.col(f"`{c}`") for c in document]).alias("document"),
    )


def table_text(df: DataFrame, rows: int = 100, width: int = 40) -> str:
    """The first rows as a bordered table; long texts are cut. For display only."""
    shown = df.select(*[collapse(F.col(f"`{c}`").cast("string"), width).alias(c) for c in df.columns]).limit(rows).collect()
    cells = [df.columns, *[["" if v is None else v for v in r] for r in shown]]
    sizes = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    line = "+" + "+".join("-" * (n + 2) for n in sizes) + "+"
    body = ["| " + " | ".join(v.ljust(n) for v, n in zip(r, sizes)) + " |" for r in cells]
    return "\n".join([line, body[0], line, *body[1:], line])


def hunt_table(hits: DataFrame, timestamp: str, shown: Sequence[str] = ()) -> DataFrame:
    """Hits as the columns of a report: timestamp (24 wide), detections (50), and the fields shown (40 each)."""
    return hits.select(
        collapse(F.col(timestamp).cast("string"), 24).alias("timestamp"), collapse(F.concat("hunt", F.lit(": "), "rule"), 50).alias("detections"),
        *[collapse(F.col(f"`{c}`").cast("string"), 40).alias(c) for c in shown],
    )
