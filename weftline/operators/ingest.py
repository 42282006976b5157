"""From cells to panels: sheet and header detection, both normalisers, and the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.schema import KEYWORDS, STOPS, monday, region_dim
from weftline.session import written

from . import panel as pn

#: Header hints.
HINTS = ("전국", "서울", "경기", "인천", "부산", "대구", "광주", "대전", "울산", "세종")
BOOK = ["source_name", "fingerprint"]
SHEET = [*BOOK, "sheet_name"]


def number(raw: Column) -> Column:
    """A number of text without commas; null where it is none or not finite."""
    x = F.replace(F.trim(raw), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def serial(x: Column) -> Column:
    """Date of a spreadsheet serial; null outside the years 1900 to 9999."""
    return F.when((x > 0) & (x < 2958466), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(x).cast("int")))


#: Spellings of a date whose signs / and - have become dots; the first that reads a text decides.
SPELLINGS = ("y.M.d", "y.M.d H:m:s", "y.M.d H:m", "y.M.d'T'H:m:s", "MMM d, y", "MMMM d, y", "d MMM y", "d MMMM y")


def _text_date(raw: Column) -> Column:
    dotted = F.regexp_replace(F.trim(raw), "[/-]", ".")
    tight = F.regexp_replace(dotted, r"\s+", "")
    read = lambda text, spelling: F.to_date(F.try_to_timestamp(text, F.lit(spelling)))
    month = F.when(tight.rlike(r"^\d{4}\.\d{1,2}$"), read(F.concat(tight, F.lit(".1")), "y.M.d"))
    return F.coalesce(read(tight, "y.M.d"), *[read(dotted, x) for x in SPELLINGS[1:]], F.when(tight.rlike(r"^\d{8}$"), read(tight, "yyyyMMdd")), month)


def library_date(raw: Column, kind: Column) -> Column:
    """Library rule: any number cell over zero is a serial; text is read as y.m.d with any of . / - or as eight digits."""
    return F.when(kind == "number", serial(raw.try_cast("double"))).otherwise(_text_date(raw))


def dashboard_date(raw: Column) -> Column:
    """Dashboard rule: anything that reads as a number over 1000 is a serial, so eight digits are out of range and give null; other text is read as y-m-d."""
    n = number(raw)
    return F.when(n > 1000, serial(n)).otherwise(_text_date(raw))


def sheet_scores(cells: DataFrame) -> DataFrame:
    """Per sheet: score and its parts on the first 8 rows and 15 columns, to four digits."""
    c = cells.where("row_idx < 8 and col_idx < 15")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "raw"))), lambda x: x["raw"]), " ")
    dates = (library_date(F.col("raw"), F.col("kind")).isNotNull()).cast("double")
    numeric = (number(F.col("raw")).isNotNull()).cast("double")
    got = c.groupBy(*SHEET, "sheet_ord", "sheet_state").agg(joined.alias("joined"), F.avg(F.when(F.col("col_idx") == 0, dates)).alias("date_ratio"), F.avg(F.when(F.col("col_idx") > 0, numeric)).alias("numeric_density"))
    words = sum((F.when(F.col("joined").contains(k), F.lit(w)).otherwise(F.lit(0.0)) for k, w in KEYWORDS.items()), F.lit(0.0))
    hints = sum((F.col("joined").contains(h).cast("int") for h in HINTS), F.lit(0))
    ratio, density = F.coalesce("date_ratio", F.lit(0.0)), F.coalesce("numeric_density", F.lit(0.0))
    seen = F.when(F.col("sheet_state") == "visible", 0.35).otherwise(-0.2)
    hint = F.when(F.col("joined").contains("구분") | (hints >= 2), 0.25).otherwise(0.0)
    return got.select(*SHEET, "sheet_ord", "sheet_state", F.bround(words + ratio * 2 + density + seen + hint, 4).alias("score"), F.bround(words, 4).alias("keyword_score"), F.bround(ratio, 4).alias("date_ratio"), F.bround(density, 4).alias("numeric_density"))


def best_sheet(scores: DataFrame) -> DataFrame:
    """The first sheet of highest score of each workbook."""
    return scores.groupBy(*BOOK).agg(F.max_by("sheet_name", F.struct("score", -F.col("sheet_ord"))).alias("sheet_name"))


def compact(cells: DataFrame) -> DataFrame:
    """Rows and columns renumbered without those that have no cell."""
    rank = lambda c: F.dense_rank().over(Window.partitionBy(*SHEET).orderBy(c)) - 1
    return cells.withColumn("r", rank("row_idx")).withColumn("c", rank("col_idx")).drop("row_idx", "col_idx").withColumnsRenamed({"r": "row_idx", "c": "col_idx"})


def header_rows(cells: DataFrame) -> DataFrame:
    """header_row of each sheet: the first of highest score among the first eight."""
    raw = F.col("raw")
    rows = cells.where("row_idx < 8").groupBy(*SHEET, "row_idx").agg(F.max((F.trim(raw) == "구분").cast("double")).alias("exact"), F.array_join(F.collect_list("raw"), " ").alias("joined"), F.count(F.lit(1)).alias("n"), F.count_if(library_date(raw, F.col("kind")).isNotNull()).alias("dates"), F.count_if(number(raw).isNotNull()).alias("numbers"))
    hints = sum((F.col("joined").contains(h).cast("double") for h in HINTS), F.lit(0.0))
    score = 3.0 * F.col("exact") + 0.8 * hints + 0.08 * F.least("n", F.lit(12)) - 0.2 * F.col("dates") - 0.05 * F.col("numbers")
    return rows.groupBy(*SHEET).agg(F.max_by("row_idx", F.struct(score, -F.col("row_idx"))).alias("header_row"))


def unique_headers(names: DataFrame) -> DataFrame:
    """names (SHEET, col_idx, raw) with header: a blank one is column_<i>, repeated ones get _2, _3 and so on."""
    base = F.when(F.trim(F.coalesce("raw", F.lit(""))) == "", F.concat(F.lit("column_"), F.col("col_idx"))).otherwise(F.trim("raw"))
    k = F.row_number().over(Window.partitionBy(*SHEET, "base").orderBy("col_idx"))
    return names.withColumn("base", base).withColumn("k", k).withColumn("header", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "k"))).drop("base", "k")


def library_rows(cells: DataFrame) -> DataFrame:
    """SHEET, region, date, raw, value of the best sheet of each workbook: every column but the dates', every row with a date."""
    # the cells of the best sheets are used often below, and written once
    best = written(compact(cells.join(best_sheet(sheet_scores(cells)), SHEET, "left_semi")))
    c = best.join(header_rows(best), SHEET)
    columns = c.select(*SHEET, "col_idx").distinct()
    names = columns.join(c.where("row_idx = header_row").select(*SHEET, "col_idx", "raw"), [*SHEET, "col_idx"], "left")
    named = unique_headers(names)
    first = named.groupBy(*SHEET).agg(F.coalesce(F.min(F.when(F.col("header") == "구분", F.col("col_idx"))), F.min("col_idx")).alias("date_col"))
    body = c.where("row_idx > header_row").join(first, SHEET)
    dates = body.where("col_idx = date_col").select(*SHEET, "row_idx", monday(library_date(F.col("raw"), F.col("kind"))).alias("date")).where("date is not null")
    values = body.where("col_idx <> date_col").join(named.select(*SHEET, "col_idx", F.col("header").alias("region")), [*SHEET, "col_idx"]).where(~F.col("region").startswith("Unnamed"))
    out = values.join(dates, [*SHEET, "row_idx"])
    return out.select(*SHEET, "region", "date", "row_idx", "raw", F.replace(F.trim("raw"), F.lit(","), F.lit("")).try_cast("double").alias("value"))


def _by_sheet(rows: DataFrame) -> DataFrame:
    """rows with region as a struct of the sheet it is in and its name: the operators of panels know regions alone, and those of different workbooks are different."""
    return rows.withColumn("region", F.struct(*SHEET, "region"))


def _checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values by region and week with the number of different ones, those of regions without conflict), by sheet."""
    one = pn.dedup_checked(_by_sheet(rows))
    bad = one.where("n_values > 1").select("region").distinct()
    return one, one.join(bad, "region", "left_anti").select("region", "date", "value")


def library_panel(rows: DataFrame) -> DataFrame:
    """date, region, value, is_imputed, source_file, sheet_name: regions with conflicting values of a week are left out, short gaps filled. Each workbook by itself."""
    _, panel = _checked(rows)
    filled = pn.fill_library(pn.weekly_grid(panel))
    return filled.select("date", F.col("region.region").alias("region"), "value", "is_imputed", F.col("region.source_name").alias("source_file"), F.col("region.sheet_name").alias("sheet_name"))


#: Messages of the report.
NO_SHEET = "No worksheet matched the weekly price-index heuristics."
EMPTY, NO_ROWS = "The detected worksheet is empty.", "The detected worksheet has no rows below the header."
NO_DATES, NO_REGIONS = "No valid date column could be parsed from the worksheet.", "No usable region columns were detected."
NO_SERIES = "No valid region series could be normalized from the worksheet."
TOO_MANY, SOME = "Numeric conversion failure ratio exceeded 20% for the uploaded worksheet.", "Some worksheet cells could not be converted into numeric values."


def layouts(cells: DataFrame) -> DataFrame:
    """Per workbook: BOOK, sheet_name, header_row, date_column, columns, sheet_scores (best first), n_body (rows below the header), n_dates (those with a date), n_regions (columns that may hold a region)."""
    scores = written(sheet_scores(cells))
    c = written(compact(cells.join(best_sheet(scores), SHEET, "left_semi")))
    head = header_rows(c)
    all_columns = c.select(*SHEET, "col_idx").distinct()
    named = unique_headers(all_columns.join(c.join(head, SHEET).where("row_idx = header_row").select(*SHEET, "col_idx", "raw"), [*SHEET, "col_idx"], "left"))
    columns = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda x: x["header"])
    date_col = F.coalesce(F.min(F.when(F.col("header") == "구분", F.col("col_idx"))), F.min("col_idx"))
    regions = (F.count_if(~F.col("header").startswith("Unnamed")) - 1).alias("n_regions")
    shape = named.groupBy(*SHEET).agg(columns.alias("columns"), date_col.alias("date_col"), regions)
    body = c.join(head, SHEET).join(shape.select(*SHEET, "date_col"), SHEET).where("row_idx > header_row")
    dated = F.when((F.col("col_idx") == F.col("date_col")) & library_date(F.col("raw"), F.col("kind")).isNotNull(), F.col("row_idx"))
    counts = body.groupBy(*SHEET).agg(F.count_distinct("row_idx").alias("n_body"), F.count_distinct(dated).alias("n_dates"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "sheet_ord", F.struct("sheet_name", "sheet_state", "score", "keyword_score", "date_ratio", "numeric_density").alias("s"))))
    ranked = scores.groupBy(*BOOK).agg(F.transform(listed, lambda x: x["s"]).alias("sheet_scores"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return shape.join(head, SHEET).join(counts, SHEET, "left").join(ranked, BOOK).select(*SHEET, "header_row", F.expr("columns[date_col]").alias("date_column"), "columns", "sheet_scores", zero("n_body"), zero("n_dates"), "n_regions")


def quality_report(rows: DataFrame, least_weeks: int = 104, layout: DataFrame | None = None, books: DataFrame | None = None) -> DataFrame:
    """Per workbook: BOOK, blocking_errors and warnings (in order, without repeats), stats, and detected_layout where layout is given.

    layout is that of layouts(); books (BOOK) lists all workbooks, so that those without any cell are reported too. A workbook
    whose sheet has no value at all is reported only with one of them.
    """
    rows = written(rows)
    keyed = _by_sheet(rows)
    one, panel = _checked(rows)
    grid = written(pn.weekly_grid(panel))
    layout = None if layout is None else written(layout)
    book = [F.col(f"region.{c}").alias(c) for c in BOOK]
    q = pn.quality(keyed, grid, least_weeks, F.col("region.region"))
    by = q.groupBy(*book).agg(F.flatten(F.array_sort(F.collect_list("blocking"))).alias("b"), F.flatten(F.array_sort(F.collect_list("warnings"))).alias("w"), F.sum("weeks").alias("rows"), F.count(F.lit(1)).alias("regions"), F.sum("imputed").alias("imputed_points"), F.max("longest_gap").alias("max_missing_run"))
    n = rows.groupBy(*BOOK).agg(F.count("raw").alias("cells"), F.count_if(F.col("value").isNull()).alias("failed"))
    # weeks are counted as the dense grid has them, whether or not any region has a value there
    weeks = grid.groupBy(*book).agg(F.count_distinct("date").alias("unique_weeks"))
    conflict = F.when(F.col("n_values") > 1, F.format_string("Region '%s' contains conflicting duplicate weekly values.", F.col("region.region")))
    conflicts = one.groupBy(*book).agg(F.count_if(F.col("n_values") > 1).alias("duplicate_conflicts"), F.array_sort(F.collect_set(conflict)).alias("cb"))
    row = n.join(by, BOOK, "full").join(weeks, BOOK, "full").join(conflicts, BOOK, "full")
    if layout is not None:
        row = row.join(layout, BOOK, "full")
    if books is not None:
        row = row.join(books.select(*BOOK).distinct(), BOOK, "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("cells", "failed", "rows", "regions", "imputed_points", "max_missing_run", "unique_weeks", "duplicate_conflicts")}
    row = row.withColumns(zero).withColumn("ratio", F.coalesce(F.try_divide("failed", "cells"), F.lit(0.0)))
    say = lambda c, *x: F.when(c, F.format_string(*x) if len(x) > 1 else F.lit(x[0]))
    first = []
    if layout is not None:
        there = F.col("header_row").isNotNull()
        first = [say(~there, NO_SHEET if books is None else EMPTY), say(there & (F.col("n_body") == 0), NO_ROWS), say(there & (F.col("n_body") > 0) & (F.col("n_dates") == 0), NO_DATES), say(there & (F.col("n_body") > 0) & (F.col("n_regions") <= 0), NO_REGIONS)]
    last = [say(F.col("ratio") > 0.2, TOO_MANY), say(F.col("rows") == 0, NO_SERIES), say((F.col("unique_weeks") > 0) & (F.col("unique_weeks") < least_weeks), "The workbook contains only %d unique weekly observations; %d are required.", "unique_weeks", F.lit(least_weeks))]
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, none)
    blocking = F.array_distinct(F.concat(F.array_compact(F.array(*first)) if first else none, some("cb"), some("b"), F.array_compact(F.array(*last))))
    warning = F.array_distinct(F.concat(some("w"), F.array_compact(F.array(say((F.col("ratio") > 0) & (F.col("ratio") <= 0.2), SOME)))))
    stats = F.struct(F.bround("ratio", 4).alias("numeric_failure_ratio"), "duplicate_conflicts", "rows", "regions", "unique_weeks", "imputed_points", "max_missing_run")
    out = [*BOOK, blocking.alias("blocking_errors"), warning.alias("warnings"), stats.alias("stats")]
    if layout is not None:
        out.append(F.struct("sheet_name", "header_row", "date_column", "columns", "sheet_scores", "fingerprint").alias("detected_layout"))
    return row.select(*out)


def report_json(report: DataFrame) -> DataFrame:
    """json: the report as indented text, letters beyond ASCII as they are."""
    parts = [c for c in ("blocking_errors", "warnings", "stats", "detected_layout") if c in report.columns]
    return report.select(F.to_json(F.struct(*parts), {"pretty": "true"}).alias("json"))


def metric_of(sheet_name: Column, preview: Column) -> Column:
    return F.when(sheet_name.contains("매매지수") | preview.contains("매매가격지수"), "매매지수").when(sheet_name.contains("전세지수") | preview.contains("전세가격지수"), "전세지수")


def sheet_inventory(cells: DataFrame) -> DataFrame:
    """sheet, metric (or -), score, rows, best first then by name."""
    raw = F.col("raw")
    got = cells.groupBy(*SHEET, "sheet_ord").agg(F.array_join(F.collect_list(F.when(F.col("row_idx") < 6, raw)), " ").alias("preview"), F.max(((raw == "서울특별시") & (F.col("row_idx") < 5)).cast("int")).alias("seoul"), (F.max("row_idx") + 1).cast("bigint").alias("rows"))
    kind = metric_of(F.col("sheet_name"), F.col("preview"))
    return got.select(*SHEET, "sheet_ord", F.coalesce(kind, F.lit("-")).alias("metric"), (F.when(kind.isNotNull(), F.lit(5)).otherwise(F.lit(0)) + 2 * F.col("seoul")).alias("score"), "rows").orderBy(F.desc("score"), "sheet_name")


def dashboard_rows(cells: DataFrame) -> DataFrame:
    """metric, sheet_name, region, region_group, date, row_idx, raw, value of the first sheet of each metric: known regions left of the first stop label."""
    first = sheet_inventory(cells).where("metric <> '-'").groupBy(*BOOK, "metric").agg(F.min_by("sheet_name", "sheet_ord").alias("sheet_name"))
    c = cells.join(first, SHEET)
    raw = F.trim("raw")
    head = c.where("row_idx < 10").groupBy(*SHEET, "row_idx").agg(F.max((raw == "구분").cast("int")).alias("a"), F.max((raw == "서울특별시").cast("int")).alias("b")).where("a = 1 and b = 1").groupBy(*SHEET).agg(F.min("row_idx").alias("header_row"))
    c = c.join(head, SHEET)
    names = c.where("row_idx = header_row").select(*SHEET, "col_idx", raw.alias("region"))
    edges = names.groupBy(*SHEET).agg(F.min(F.when(F.col("region") == "구분", F.col("col_idx"))).alias("date_col"), F.collect_list(F.when(F.col("region").isin(*STOPS), F.col("col_idx"))).alias("stops"), (F.max("col_idx") + 1).alias("end"))
    edges = edges.select(*SHEET, "date_col", F.coalesce(F.array_min(F.filter("stops", lambda x: x > F.col("date_col"))), F.col("end")).alias("stop"))
    own = names.join(edges, SHEET).where("col_idx > date_col and col_idx < stop").join(F.broadcast(region_dim(cells.sparkSession)), "region").select(*SHEET, "col_idx", "region", "region_group")
    body = c.where("row_idx > header_row").join(edges, SHEET)
    dates = body.where("col_idx = date_col").select(*SHEET, "row_idx", monday(dashboard_date(F.col("raw"))).alias("date")).where("date is not null")
    return body.join(own, [*SHEET, "col_idx"]).join(dates, [*SHEET, "row_idx"]).select(*BOOK, "metric", "sheet_name", "region", "region_group", "date", "row_idx", "raw", number(F.col("raw")).alias("value"))


def dashboard_panel(rows: DataFrame) -> DataFrame:
    """BOOK, date, value, region, region_group, metric, sheet_name, is_imputed: the last value of a week, gaps filled two weeks from either side. Each workbook by itself."""
    # the operators of panels know regions; what belongs to one goes with it
    key = [*BOOK, "metric", "region", "region_group", "sheet_name"]
    one = rows.select(F.struct(*key).alias("region"), "date", "value", "row_idx")
    filled = pn.fill_dashboard(pn.weekly_grid(pn.dedup_last(one, "row_idx")))
    own = lambda *names: [F.col(f"region.{c}").alias(c) for c in names]
    return filled.select(*own(*BOOK), "date", "value", *own("region", "region_group", "metric", "sheet_name"), "is_imputed")


def series_of(panel: DataFrame, metric: str) -> DataFrame:
    """region, date, value of one metric for analysis; the filter reaches a panel that is stored by metric."""
    rows = panel.where(F.col("metric") == metric).select("region", "date", "value")
    return pn.interpolated(pn.weekly_grid(rows), 2).where("filled is not null").select("region", "date", F.col("filled").alias("value"))
