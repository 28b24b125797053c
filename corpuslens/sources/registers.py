"""Readers of registers, indexes and configuration; each checks what it reads."""

from __future__ import annotations

import html.parser
import io
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from corpuslens.functions.text import employer_name


def checked_csv(spark: SparkSession, path: str, required: Sequence[str], *, unique: Sequence[str] = ()) -> DataFrame:
    """A CSV table with header, values trimmed and null as blank; missing or repeated columns are an error, as are repeated keys."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    rows = rows.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in rows.columns))
    if unique:
        again = rows.groupBy(*unique).count().where("count > 1").limit(1).collect()
        if again:
            raise ValueError(f"{path} repeats the key {tuple(again[0])[:-1]}")
    return rows


def typed_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidate manifest with dates and numbers; a value that can't be read is an error."""
    rows = checked_csv(spark, path, ("deal_id", "announcement_date", "target_name", "acquirer_name", "source_file", "source_row_number", "candidate_score"))
    return rows.withColumns({"announcement_date": F.to_date("announcement_date", "yyyy-MM-dd"), "source_row_number": F.col("source_row_number").cast("int"), "candidate_score": F.col("candidate_score").cast("int")})


def nth_row(rows: DataFrame, wanted: DataFrame, *, file: str = "source_file", row: str = "source_row") -> DataFrame:
    """The physical rows that ``wanted`` (file, row) names; a name without a row keeps nulls."""
    held = rows.select(F.col(file).alias("_f"), F.col(row).alias("_r"), *(c for c in rows.columns if c not in (file, row)))
    return wanted.join(held, (F.col(file) == F.col("_f")) & (F.col(row) == F.col("_r")), "left").drop("_f", "_r")


def scored_candidates(rows: DataFrame, *, ident: str, name: str, date: str, file: str, patterns: Sequence[tuple[str, int]], first_year: int, last_year: int) -> DataFrame:
    """Rows of many files whose name matches weighted patterns, one an id from its first file; adds score and matched patterns."""
    hit = lambda p: F.coalesce(F.col(name).rlike(f"(?i){p}"), F.lit(False))
    score = sum((F.when(hit(p), w).otherwise(0) for p, w in patterns), F.lit(0))
    terms = F.concat_ws(";", *(F.when(hit(p), F.lit(p)) for p, _ in patterns))
    dated = rows.where((F.coalesce(F.col(ident), F.lit("")) != "") & F.year(date).between(first_year, last_year))
    kept = dated.withColumns({"score": score, "matched_terms": terms}).where("score > 0")
    everything = F.struct(*(F.col(c) for c in kept.columns))
    return kept.groupBy(ident).agg(F.min_by(everything, F.col(file)).alias("r")).select("r.*")


def approved_sources(rows: DataFrame, *, classes: Sequence[str], longest: int = 2000) -> DataFrame:
    """Approved rows of a curated register; a source without https, an unknown class or an excerpt over ``longest`` characters is an error."""
    kept = rows.where(F.lower(F.trim("review_status")) == "approved")
    wrong = F.when(~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "url").when(~F.coalesce(F.col("source_class").isin(*classes), F.lit(False)), "source_class").when(F.length("excerpt") > longest, "excerpt")
    return kept.withColumn("url", F.when(wrong.isNull(), F.col("url")).otherwise(F.raise_error(F.concat(F.lit("register: bad "), wrong))))


def cell_totals(rows: DataFrame, *, employer: str, status: str, amount: str, aliases: Sequence[str]) -> DataFrame:
    """(employer, cases, total) of certified rows of the aliases, exact decimals; an amount that can't be read is an error."""
    value = F.regexp_replace(F.trim(F.coalesce(F.col(amount), F.lit(""))), ",", "")
    number = F.when(value == "", F.lit(0).cast("decimal(20,4)")).otherwise(value.cast("decimal(20,4)"))
    kept = rows.where(F.upper(F.trim(F.coalesce(F.col(status), F.lit("")))).startswith("CERTIFIED")).select(employer_name(F.col(employer)).alias("employer"), number.alias("n"))
    return kept.where(F.col("employer").isin(*aliases)).groupBy("employer").agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("total"))


def coverage_grid(aliases: DataFrame, totals: DataFrame, years: Sequence[int]) -> DataFrame:
    """Every alias and fiscal year with its totals, 0 where there are none, and whether the year is before or after its deal.

    aliases: deal_id, employer, pre_year, post_year; totals: employer, fiscal_year, cases, total.
    """
    grid = aliases.withColumn("fiscal_year", F.explode(F.array(*map(F.lit, years))))
    held = totals.select(F.col("employer").alias("_e"), F.col("fiscal_year").alias("_y"), "cases", "total")
    rows = grid.join(held, (F.col("employer") == F.col("_e")) & (F.col("fiscal_year") == F.col("_y")), "left")
    period = F.when(F.col("fiscal_year") == F.col("pre_year"), "pre").when(F.col("fiscal_year") == F.col("post_year"), "post").otherwise("")
    return rows.select("deal_id", "employer", "fiscal_year", period.alias("period"), F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("total", F.lit(0)).alias("total"))


def physical_lines(spark: SparkSession, path: str) -> int:
    """Lines of a text file without its header line, blank ones included."""
    return max(0, spark.read.text(path).count() - 1)


class _Index(html.parser.HTMLParser):
    """Rows of tables as lists of (text, first link)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, str | None]]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = ["", None]
        elif tag == "a" and self.cell is not None and self.cell[1] is None:
            self.cell[1] = dict(attrs).get("href")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append((" ".join(self.cell[0].split()), self.cell[1]))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data


def index_documents(page: str | None, primary: str | None) -> list[dict]:
    """Documents of a filing's index: of the first table with headings document and type, rows of four cells or more with a link in the third; of one name the last row counts."""
    parser = _Index()
    parser.feed(page or "")
    found: dict[str, dict] = {}
    for table in parser.tables:
        heads = {text.lower() for text, _ in table[0]} if table else set()
        if not {"document", "type"} <= heads:
            continue
        for row in table[1:]:
            if len(row) >= 4 and row[2][1]:
                name = row[2][1].rsplit("/", 1)[-1].split("?")[0]
                found[name] = {"document_name": name, "description": row[1][0], "document_type": row[3][0], "href": row[2][1], "is_primary": name == primary}
        break
    return list(found.values())


@F.pandas_udf(ArrayType(StructType([*(StructField(c, StringType()) for c in ("document_name", "description", "document_type", "href")), StructField("is_primary", BooleanType())])))
def documents_of_index(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, primary in batches:
        yield pd.Series([index_documents(p, f) for p, f in zip(pages, primary, strict=True)], dtype=object)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes, columns: Sequence[str]) -> Iterator[tuple[str | None, ...]]:
    """The named columns of a workbook's first sheet, read as a stream; a missing column is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, item in ET.iterparse(book.open("xl/sharedStrings.xml")):
                if item.tag == f"{_SHEET}si":
                    shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
                    item.clear()
        sheet = min(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))
        places: dict[str, str] | None = None
        for _, row in ET.iterparse(book.open(sheet)):
            if row.tag != f"{_SHEET}row":
                continue
            cells = {}
            for c in row.iter(f"{_SHEET}c"):
                value = c.findtext(f"{_SHEET}v")
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                elif c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                cells["".join(x for x in c.get("r", "") if x.isalpha())] = value
            row.clear()
            if places is None:
                places = {str(v or "").strip().upper(): at for at, v in cells.items()}
                missing = [c for c in columns if c.upper() not in places]
                if missing:
                    raise ValueError(f"the sheet lacks columns {missing}")
                continue
            yield tuple(cells.get(places[c.upper()]) for c in columns)


def workbooks(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(path, *columns) of the first sheets of the workbooks under ``path``; one task reads one book as a stream."""
    names = [c.lower() for c in columns]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                held: list[tuple] = []
                for row in sheet_rows(content, columns):
                    held.append((file, *row))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["path", *names])
                        held = []
                yield pd.DataFrame(held, columns=["path", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, ", ".join(f"`{c}` string" for c in ["path", *names]))


def settings(text: str, required: dict[str, type]) -> dict:
    """A TOML configuration with ``section.key`` of the given types; a missing or ill-typed one is an error."""
    found = tomllib.loads(text)
    for name, kind in required.items():
        at = found
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                raise ValueError(f"configuration lacks {name}")
            at = at[part]
        if isinstance(at, bool) and kind is not bool or not isinstance(at, kind):
            raise TypeError(f"{name} must be {kind.__name__}")
    return found


def code_rationale(code: Column, codes: dict[str, str], version: str) -> Column:
    """Why a code is in the screen, or null."""
    table = F.create_map(*(F.lit(v) for pair in codes.items() for v in pair))
    label = F.try_element_at(table, F.trim(code))
    return F.when(label.isNotNull(), F.concat(F.lit(f"{version}: "), F.trim(code), F.lit(" "), label))
