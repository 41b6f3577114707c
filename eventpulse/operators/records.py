"""Records from ordered lines and cell grids. Order is by file and line number; a file is one partition's work."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from eventpulse.functions.text import normalize_time, present, safe_float, safe_int
from eventpulse.operators.numbering import numbered


def file_order() -> WindowSpec:
    return W.partitionBy("file").orderBy("line_no")


def anchored_records(lines: DataFrame, anchor: str, before: list[str], after: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, warnings): an anchor line owns the lines before it (named from far to near) and after it; anchors too close
    to an edge are warnings."""
    window = file_order()
    out = lines.withColumns({n: F.lag("line", len(before) - i).over(window) for i, n in enumerate(before)} | {n: F.lead("line", i + 1).over(window) for i, n in enumerate(after)})
    out = out.filter(F.col("line").rlike(anchor))
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in (*before, *after)])
    records = out.filter(whole).withColumns({"row_index": F.row_number().over(window), "line_start": F.col("line_no") - len(before), "line_end": F.col("line_no") + len(after), "raw": F.concat_ws("\n", *before, "line", *after)})
    return records, out.filter(~whole).select("file", "line_no", F.lit("anchor too close to an edge").alias("warning"))


def start_marked_records(lines: DataFrame, gate: str, start: str, stop: str) -> DataFrame:
    """After the gate line and before the stop line a start line opens a record, and the lines after it belong to it."""
    whole = W.partitionBy("file")
    out = lines.withColumn("_gate", F.min(F.when(F.col("line").rlike(gate), F.col("line_no"))).over(whole))
    out = out.filter(F.col("line_no") > F.col("_gate")).withColumn("_stop", F.min(F.when(F.col("line").rlike(stop), F.col("line_no"))).over(whole))
    out = out.filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop"))).withColumn("record", F.sum(F.col("line").rlike(start).cast("int")).over(file_order().rowsBetween(W.unboundedPreceding, 0)))
    return out.filter("record > 0").groupBy("file", "record").agg(
        F.min_by("line", "line_no").alias("title"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.count("*").alias("lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"),
    )


def end_marked_records(lines: DataFrame, detail: str, flag: str) -> tuple[DataFrame, DataFrame]:
    """(records, leftovers): lines pend until a detail line closes them; the first pending line other than the flag token is
    the name, the flag token being there is the flag, the detail's first group a field."""
    ends = F.col("line").rlike(detail).cast("int")
    out = lines.withColumn("_after", F.coalesce(F.sum(ends).over(file_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = out.groupBy("file", "_after").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("own"))
    last = F.element_at("own", -1)["line"]
    pending = F.transform(F.when(last.rlike(detail), F.slice("own", F.lit(1), F.size("own") - 1)).otherwise(F.col("own")), lambda x: x["line"])
    rows = rows.withColumns({"_closed": last.rlike(detail), "_pending": pending, "_detail": last})
    records = rows.filter("_closed").select(
        "file", (F.col("_after") + 1).alias("record"), F.coalesce(F.try_element_at(F.filter("_pending", lambda x: x != flag), F.lit(1)), F.lit("")).alias("name"), F.array_contains("_pending", flag).alias("flagged"),
        F.regexp_extract("_detail", detail, 1).alias("detail"),
    )
    return records, rows.filter("not _closed").select("file", F.size("_pending").cast("long").alias("leftover_lines"))


def expected_count_check(records: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys whose number of records isn't the expected one."""
    found = records.groupBy(key).agg(F.count("*").alias("found"))
    out = expected.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.filter("found <> expected").select(key, "expected", "found")


def carry_forward_pairs(lines: DataFrame, header: str, item: str, following: str) -> DataFrame:
    """Items with the last header's number, kept only if the next line has the two numbers of `following`."""
    day = F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1).try_cast("int"))
    out = lines.withColumns({"day": F.last(day, ignorenulls=True).over(file_order().rowsBetween(W.unboundedPreceding, 0)), "_next": F.lead("line").over(file_order())})
    out = out.filter(F.col("line").rlike(item) & F.col("_next").rlike(following) & F.col("day").isNotNull())
    return out.select("file", "line_no", "day", "line", F.regexp_extract("_next", following, 1).try_cast("long").alias("reserved"), F.regexp_extract("_next", following, 2).try_cast("long").alias("capacity"))


def infer_month_rollover(items: DataFrame, year: int, start_month: int) -> DataFrame:
    """A day below the one before opens the next month: date, fill rate, and review of impossible dates or counts."""
    drop = (F.col("day") < F.lag("day").over(file_order())).cast("int")
    out = items.withColumn("_drop", F.coalesce(drop, F.lit(0))).withColumn("_month", start_month + F.sum("_drop").over(file_order().rowsBetween(W.unboundedPreceding, 0)) - 1)
    text = F.concat_ws("-", (year + F.floor(F.col("_month") / 12)).cast("string"), F.lpad((F.col("_month") % 12 + 1).cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0"))
    out = out.withColumns({"class_date": F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"), "fill_rate": F.try_divide(F.col("reserved").cast("double"), F.col("capacity").cast("double"))})
    return out.withColumn("needs_review", F.col("class_date").isNull() | F.col("fill_rate").isNull() | (F.col("reserved") > F.col("capacity"))).drop("_drop", "_month")


def grid_carry_header(cells: DataFrame, header: str, wanted: str) -> DataFrame:
    """A row with any header cell only renews the headers of its columns; later cells that are wanted take their column's last one."""
    is_header = F.col("value").rlike(header)
    out = cells.withColumn("_row", F.max(is_header.cast("int")).over(W.partitionBy("sheet", "row_idx")))
    column = W.partitionBy("sheet", "col_idx").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("header", F.last(F.when(is_header, F.col("value")), ignorenulls=True).over(column))
    return out.filter((F.col("_row") == 0) & F.col("value").rlike(wanted) & F.col("header").isNotNull()).drop("_row")


def parse_program_cell(df: DataFrame, cell: str, boilerplate: str) -> DataFrame:
    """Start, end, [location], first acceptable title line, instructors, capacity and needs_review of a cell's lines."""
    text = F.coalesce(F.col(cell), F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    titles = F.filter(lines, lambda x: ~x.rlike(r"\d{1,2}[:;]\d{2}") & ~x.rlike(r"^\[") & ~x.rlike(boilerplate) & ~x.rlike("^(?:with|by) "))
    people = F.transform(F.filter(lines, lambda x: x.rlike("^(?:with|by) ")), lambda x: F.regexp_replace(x, "^(?:with|by) ", ""))
    capacity = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("long") for p in (r"capacity[: ]+(\d+)", r"(\d+) seats", r"\((\d+)\)")])
    out = df.withColumns({
        "start_time": normalize_time(F.regexp_extract(text, r"(\d{1,2}[:;]\d{2})", 1)), "end_time": normalize_time(F.regexp_extract(text, r"\d{1,2}[:;]\d{2}\s*[-~]\s*(\d{1,2}[:;]\d{2})", 1)),
        "location": F.regexp_extract(text, r"\[([^\]]*)\]", 1), "title": F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit("")), "instructors": F.array_join(people, " / "), "capacity": capacity,
    })
    return out.withColumn("needs_review", (F.col("start_time") == "") | (F.col("title") == "") | F.col("capacity").isNull())


def grid_to_table(cells: DataFrame, headers: list[str], order: str) -> DataFrame:
    """Below the first row with all headers: one row for each grid row whose order cell starts with a digit."""
    of_row = cells.filter(F.col("value").isin(headers)).groupBy("sheet", "row_idx").agg(F.count_distinct("value").alias("n")).filter(F.col("n") == len(headers))
    head = of_row.groupBy("sheet").agg(F.min("row_idx").alias("_head"))
    names = cells.join(head, "sheet").filter((F.col("row_idx") == F.col("_head")) & F.col("value").isin(headers)).groupBy("sheet", "value").agg(F.min("col_idx").alias("col_idx")).withColumnRenamed("value", "_name")
    below = cells.join(head, "sheet").filter(F.col("row_idx") > F.col("_head")).join(names, ["sheet", "col_idx"])
    wide = below.groupBy("sheet", "row_idx").pivot("_name", headers).agg(F.min("value"))
    return wide.na.fill("", headers).filter(F.col(f"`{order}`").rlike("^[0-9]"))


RATINGS = ("overall", "teaching", "mood", "place")


def parse_review_text(df: DataFrame, text: str) -> DataFrame:
    """Reviewer, day, visit, four ratings, title (three fallbacks), ticket and body of a captured review; what is missing is
    listed in parse_warnings."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.array_join(lines, "\n")
    ticket = F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.rlike("(?i)ticket|pass")), F.lit(1)), F.lit(""))
    end = F.array_position(lines, ticket)
    title = F.coalesce(*[F.nullif(F.regexp_extract(whole, p, 1), F.lit("")) for p in (r"(?m)^Class: (.+)$", r"(?m)^\[(.+)\]", r"(?m)^(.+) class$")], F.lit(""))
    day = F.regexp_extract(whole, r"(\d{4}-\d{2}-\d{2})", 1)
    fields = {
        "reviewer": F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), "review_date": day, "visit_count": safe_int(F.regexp_extract(whole, r"visit (\d+)", 1)),
        **{f"{r}_rating": safe_float(F.regexp_extract(whole, rf"{r} (\d(?:\.\d)?)", 1)) for r in RATINGS}, "class_title": title, "ticket": ticket,
        "body": F.array_join(F.when(end > 0, F.slice(lines, F.lit(2), F.greatest(end.cast("int") - 2, F.lit(0)))).otherwise(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"),
    }
    out = df.withColumns(fields)
    missing = F.array_compact(F.array(*[F.when(~present(F.col(c).cast("string")), F.lit(c)) for c in ("reviewer", "review_date", "visit_count", *[f"{r}_rating" for r in RATINGS], "class_title", "ticket", "body")]))
    return out.withColumns({"parse_warnings": F.array_join(missing, ";"), "needs_review": F.size(missing) > 0})


def field_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(present(F.col(c).cast("string"))).alias(c) for c in columns])
    return counts.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("f")).select("f.field", "f.filled", "rows")


class _Selected(HTMLParser):
    """Text inside the first element that a selector names, without script, style and frames."""

    VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())

    def __init__(self, tag: str, name: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.name, self.depth, self.skip, self.parts, self.found = tag, name, 0, 0, [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "iframe"):
            self.skip += 1
        elif self.depth:
            self.depth += tag == self.tag
            self.parts.append("\n")
        elif not self.found and tag == self.tag and (self.name is None or self.name in ((dict(attrs).get("class") or "") + " " + (dict(attrs).get("id") or "")).split()):
            self.depth, self.found = 1, True

    def handle_endtag(self, tag):
        if tag in ("script", "style", "iframe"):
            self.skip = max(0, self.skip - 1)
        elif self.depth:
            self.depth -= tag == self.tag
            self.parts.append("\n")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


def extract_selected_text(pages: DataFrame, key: str, url: str, html: str, selectors: list[tuple[str, str | None]]) -> DataFrame:
    """(key, body, selector, chars, lines, status): text of the first selector (tag, class or id) that gives any; status
    success, empty_body, missing_url or failed."""

    def one(address: str | None, page: str | None) -> tuple[str, str, str]:
        if not address:
            return "", "", "missing_url"
        try:
            for tag, name in selectors:
                parser = _Selected(tag, name)
                parser.feed(page or "")
                lines = [" ".join(x.split()) for x in "".join(parser.parts).split("\n")]
                body = "\n".join(x for x in lines if x)
                if body:
                    return body, tag if name is None else f"{tag}.{name}", "success"
        except (AssertionError, ValueError):
            return "", "", "failed"
        return "", "", "empty_body"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [one(u, h) for u, h in zip(frame[url], frame[html], strict=True)]
            yield pd.DataFrame({key: frame[key], "body": [f[0] for f in found], "selector": [f[1] for f in found], "status": [f[2] for f in found]})

    kind = dict(pages.dtypes)[key]
    out = pages.select(key, url, html).mapInPandas(run, f"{key} {kind}, body string, selector string, status string")
    return out.withColumns({"chars": F.length("body").cast("long"), "lines": F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))).cast("long")})


def enrich_hits(hits: DataFrame, items: DataFrame, owners: DataFrame, item: str, owner: str) -> DataFrame:
    """Hits with item details and owner details, of each id the first by its other columns."""

    def firsts(rows: DataFrame, key: str) -> DataFrame:
        others = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_first")).select(key, "_first.*") if others else rows.distinct()

    return hits.join(firsts(items, item), item, "left").join(firsts(owners, owner), owner, "left")


def query_hit_counts(hits: DataFrame, queries: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(hits with query_rank, per query hits and the distinct values of item and, where hits have them, of link and owner;
    zero included)."""
    ranked = numbered(hits, ["query"], [order], "query_rank")
    distinct = [c for c in ("item", "link", "owner") if c in hits.columns]
    counts = hits.groupBy("query").agg(F.count("*").alias("hits"), *[F.count_distinct(c).alias(f"unique_{c}s") for c in distinct])
    return ranked, queries.join(counts, "query", "left").na.fill(0, ["hits", *[f"unique_{c}s" for c in distinct]])

