"""Readers of dimension files and vendor payloads, and the sinks of results."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import parse_date, parse_number
from ..operators.ingest import clean_universe

#: Names under which a file may hold its ticker column.
TICKER_NAMES = ("stock", "ticker", "symbol", "Stock", "Ticker", "Symbol")


def renamed(df: DataFrame, names, to: str) -> DataFrame:
    """The first column found among ``names`` under the name ``to``."""
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {list(names)} is there")
    return df.withColumnRenamed(found, to)


def universe_file(spark: SparkSession, path: str, inactive: DataFrame | None = None) -> DataFrame:
    """Tickers of a .csv with a ticker column, or of a .txt with one a line."""
    raw = renamed(spark.read.csv(path, header=True), TICKER_NAMES, "stock") if path.endswith(".csv") else spark.read.text(path).withColumnRenamed("value", "stock")
    return clean_universe(raw, "stock", inactive)


def rename_file(spark: SparkSession, path: str) -> DataFrame:
    """(old_ticker, new_ticker), upper-cased."""
    raw = spark.read.schema("old_ticker string, new_ticker string, note string").csv(path, header=True)
    return raw.where("old_ticker IS NOT NULL").select(F.upper(F.trim("old_ticker")).alias("old_ticker"), F.upper(F.trim("new_ticker")).alias("new_ticker"))


def company_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).select(F.col("ticker").alias("stock"), F.col("name").alias("company_name"))


def index_members(table: DataFrame) -> DataFrame:
    """Members from a scraped table (Symbol, Security, GICS Sector, GICS Sub-Industry)."""
    return table.select(
        F.translate("Symbol", ".", "-").alias("stock"), F.col("Security").alias("company_name"), F.col("GICS Sector").alias("sector"), F.col("GICS Sub-Industry").alias("sub_sector")
    )


class _Table(HTMLParser):
    """The cells of a page's first table."""

    def __init__(self):
        super().__init__()
        self.rows, self.depth, self.over, self.cell = [], 0, False, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.depth != 1 or self.over:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.depth == 1:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table":
            self.depth -= 1
            self.over |= self.depth == 0

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_table(spark: SparkSession, page: str) -> DataFrame:
    """The first table of one HTML page, named by its first row; all columns are strings."""
    parser = _Table()
    parser.feed(page)
    head, *rows = [r for r in parser.rows if r] or [[]]
    if not head:
        raise ValueError("the page has no table")
    rows = [tuple((r + [None] * len(head))[: len(head)]) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in head))


def price_payload(raw: DataFrame) -> DataFrame:
    """(stock, date, price) from (stock, body): a JSON map of dates to values."""
    rows = raw.select("stock", F.explode(F.from_json("body", "map<string,string>")).alias("d", "v"))
    return rows.select("stock", parse_date(F.col("d")).alias("date"), parse_number(F.col("v")).alias("price"))


def earnings_payload(raw: DataFrame) -> DataFrame:
    """Events from (stock, body): a JSON array; "None" and "" are null, surprises are per cent."""
    kind = "array<struct<reportedDate:string,fiscalDateEnding:string,reportedEPS:string,estimatedEPS:string,surprisePercentage:string>>"
    e = raw.select("stock", F.explode(F.from_json("body", kind)).alias("e")).select("stock", "e.*")
    number = lambda c: parse_number(F.nullif(F.nullif(F.col(c), F.lit("None")), F.lit("")))
    return e.select(
        "stock", parse_date(F.col("reportedDate")).alias("earnings_date"), parse_date(F.col("fiscalDateEnding")).alias("fiscal_end_date"),
        number("reportedEPS").alias("reported_eps"), number("estimatedEPS").alias("estimated_eps"), (number("surprisePercentage") / 100).alias("surprise_percentage"),
    )


def close_matrix(wide: DataFrame, tickers) -> DataFrame:
    """(date, stock, price) from a matrix of a column per stock, without gaps."""
    return wide.unpivot(["date"], list(tickers), "stock", "price").where("price IS NOT NULL")


def batched(stocks: DataFrame, size: int = 100) -> DataFrame:
    """(stock, batch, slot) of a table of stocks, which is one row each: batches of ``size`` in order of their names."""
    n = F.row_number().over(Window.orderBy("stock")) - 1
    return stocks.select("stock").distinct().select("stock", F.floor(n / size).cast("int").alias("batch"), (n % size).cast("string").alias("slot"))


def close_matrices(prices: DataFrame, batches: DataFrame, size: int = 100) -> DataFrame:
    """(date, batch, a column per slot) of (stock, date, price): the matrix of each batch of stocks."""
    slots = [str(i) for i in range(size)]
    return prices.join(batches, "stock").groupBy("date", "batch").pivot("slot", slots).agg(F.first("price"))


def close_rows(wide: DataFrame, batches: DataFrame) -> DataFrame:
    """(date, stock, price) from the matrices of all batches, without gaps."""
    slots = [c for c in wide.columns if c not in ("date", "batch")]
    rows = wide.unpivot(["date", "batch"], slots, "slot", "price").where("price IS NOT NULL")
    return rows.join(batches, ["batch", "slot"]).select("date", "stock", "price")


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_text(df: DataFrame, path: str, widths: dict) -> None:
    """A fixed-width table, in the order of the rows."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), n, " ") for c, n in widths.items()]
    df.select(F.concat(*cells).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_html(df: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small result as one HTML page; larger ones belong into the other sinks."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a page holds at most {most} rows")
    cell = lambda tag, x: f"<{tag}>{escape('-' if x is None else str(x))}</{tag}>"
    lines = ["".join(cell("th", c) for c in df.columns), *("".join(cell("td", x) for x in r) for r in rows)]
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{''.join(f'<tr>{x}</tr>' for x in lines)}</table></body></html>"
    df.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)


_run_folders: dict[tuple, str] = {}


def run_folder(spark: SparkSession, base: str, day) -> str:
    """The folder of a day's run, emptied on the first call of this application and kept by later ones."""
    key = (spark.sparkContext.applicationId, base, str(day))
    if key not in _run_folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/output_{day:%Y_%m_%d}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(path, True)
        fs.mkdirs(path)
        _run_folders[key] = f"{base.rstrip('/')}/output_{day:%Y_%m_%d}"
    return _run_folders[key]


def latest_run(names: list[str]) -> str | None:
    """The last of the dated run folders."""
    return max(names, default=None)
