"""Nested vendor files: fund screeners of unknown shape, fund workbooks, recorded exchange messages.

JSON is walked as VARIANT values, level by level in Spark; spreadsheets in XML are cut by
expressions, since their texts are no well-formed XML. Nothing is walked on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import kept
from .vendor import number

# Names under which issuers publish a figure, lower case without spaces.
SHARES = ("sharesoutstanding", "shares_outstanding", "sharesout", "sharecount")
ASSETS = ("totalnetassets", "total_net_assets", "netassets", "fundnetassets", "aum")
NAV = ("nav", "navamount", "netassetvalue")
#: A figure may be wrapped in an object under one of these.
WRAPPED = ("r", "raw", "value")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def walked(documents: DataFrame, deepest: int = 64) -> DataFrame:
    """Every value of JSON documents (doc: an id, v: VARIANT): doc, path (positions from the root), parent (the path of what
    holds it), key (null in an array), kind (OBJECT, ARRAY, STRING, ...), v. The members of an object are in the order of their names.

    One pass a level: a level's objects and arrays give the next one, until none is left. Levels are written, so none
    is walked twice. It is an error if documents are nested deeper than `deepest`."""
    none = F.array().cast("array<int>")
    level = documents.where("v IS NOT NULL").select("doc", none.alias("path"), F.lit(None).cast("array<int>").alias("parent"), F.lit(None).cast("string").alias("key"), _kind(F.col("v")).alias("kind"), "v")
    out = None
    for _ in range(deepest + 1):
        level = kept(level, "walk")
        out = level if out is None else out.unionByName(level)
        inner = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            return out
        name = f"walk_{level.semanticHash() & 0xFFFFFFFF}"
        inner.createOrReplaceTempView(name)
        spark = documents.sparkSession
        level = spark.sql(f"SELECT d.doc, concat(d.path, array(x.pos)) AS path, d.path AS parent, x.key, x.value AS v FROM {name} d, LATERAL variant_explode(d.v) x").withColumn("kind", _kind(F.col("v"))).select("doc", "path", "parent", "key", "kind", "v")
    raise ValueError(f"documents are nested deeper than {deepest}")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _figure(value: Column, kind: Column) -> Column:
    """A number, bare, as text with marks, or wrapped in an object; null for a placeholder."""
    plain = lambda text: number(F.regexp_replace(F.trim(text), "[,$%]", ""))
    inner = F.coalesce(*(F.try_variant_get(value, f"$.{w}", "string") for w in WRAPPED))
    return plain(F.when(kind == "OBJECT", inner).when(kind == "ARRAY", F.lit(None)).otherwise(_text(value)))


def fund_screener(spark: SparkSession, path: str, tickers: list[str]) -> DataFrame:
    """file, ticker, shares_outstanding, total_net_assets, nav, shares_basis of each fund of `tickers` in screener documents.

    A record is an object, at whatever depth, that holds a wanted ticker as a text value; the first of a document
    counts. A missing share count is net assets over NAV (`derived`). Files that are no JSON give no rows."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.try_parse_json("value").alias("v"))
    wanted = [t.upper() for t in tickers]
    cells = walked(texts).where("key IS NOT NULL").withColumn("name", F.regexp_replace(F.lower("key"), " ", ""))
    upper = F.upper(_text(F.col("v")))
    figure = _figure(F.col("v"), F.col("kind"))
    first = lambda names: F.min(F.when(F.col("name").isin(*names) & figure.isNotNull(), F.struct(F.element_at("path", -1).alias("at"), figure.alias("x"))))["x"]
    records = cells.groupBy("doc", "parent").agg(
        F.min(F.when((F.col("kind") == "STRING") & upper.isin(wanted), F.struct(F.element_at("path", -1).alias("at"), upper.alias("x"))))["x"].alias("ticker"), first(SHARES).alias("shares"), first(ASSETS).alias("assets"), first(NAV).alias("nav")
    )
    one = records.where("ticker IS NOT NULL").groupBy("doc", "ticker").agg(F.min(F.struct("parent", "shares", "assets", "nav")).alias("x"))
    x = F.col("x")
    derived = x["shares"].isNull() & x["assets"].isNotNull() & (x["nav"] != 0)
    return one.select(F.col("doc").alias("file"), "ticker", F.when(derived, x["assets"] / x["nav"]).otherwise(x["shares"]).alias("shares_outstanding"), x["assets"].alias("total_net_assets"), x["nav"].alias("nav"), F.when(derived, "derived").otherwise("reported").alias("shares_basis"))


def fund_workbook(spark: SparkSession, path: str, sheet: str = "Historical") -> DataFrame:
    """file, day, nav, shares_outstanding, ex_dividend, flow_usd: the rows of one sheet of fund workbooks (SpreadsheetML).

    Rows without a date or a number are left out. flow_usd is the change in shares since the row before at the day's
    NAV, null for the first. Columns are found by their headings."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("value").contains("<ss:Workbook"))
    body = F.substring_index(F.expr(f"substring(value, locate('Name=\"{sheet}\"', value))"), "</ss:Worksheet>", 1)
    rows = F.regexp_extract_all(body, F.lit(r"(?s)<ss:Row[^>]*>(.*?)</ss:Row>"), F.lit(1))
    found = text.where(F.col("value").contains(f'Name="{sheet}"')).select("file", F.transform(rows, lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<ss:Data[^>]*>(.*?)</ss:Data>"), F.lit(1)), lambda c: F.trim(c))).alias("rows"))
    cells = found.where(F.size("rows") > 1).select("file", F.transform(F.element_at("rows", 1), F.lower).alias("head"), F.explode(F.slice("rows", 2, 2_147_483_647)).alias("row"))
    cell = lambda name: F.when(F.array_contains("head", name), F.get("row", (F.array_position("head", name) - 1).cast("int")))
    day = F.to_date(F.try_to_timestamp(cell("as of"), F.lit("MMM d, yyyy")))
    out = cells.select("file", day.alias("day"), number(cell("nav per share")).alias("nav"), number(cell("shares outstanding")).alias("shares_outstanding"), F.nullif(cell("ex-dividends"), F.lit("")).alias("ex_dividend")).dropna(subset=["day", "nav", "shares_outstanding"])
    before = F.lag("shares_outstanding").over(Window.partitionBy("file").orderBy("day"))
    return out.withColumn("flow_usd", (F.col("shares_outstanding") - before) * F.col("nav"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Lines of recordings: venue (the folder two above the file), file, t (seconds), m (VARIANT; null if the line or its message is no JSON).

    A line holds its message as a text of JSON: one object, or an array of which each element is a message. Compressed
    files that end early give what they hold."""
    text = spark.read.option("ignoreCorruptFiles", True).text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    parts = F.split("file", "/")
    raw = text.select(F.element_at(parts, -3).alias("venue"), "file", "at", F.try_variant_get("line", "$.recorded_at", "double").alias("t"), F.try_parse_json(F.try_variant_get("line", "$.raw", "string")).alias("m"))
    whole = raw.withColumn("all", F.when(_kind(F.col("m")) == "ARRAY", F.try_variant_get("m", "$", "array<variant>")).otherwise(F.array("m")))
    return whole.select("venue", "file", "t", "at", F.posexplode_outer("all").alias("nth", "m"))


def unreadable(lines: DataFrame) -> DataFrame:
    """file, lines, bad: how many messages of each file could not be read."""
    bad = F.col("m").isNull() | F.col("t").isNull() | (_kind(F.col("m")) != "OBJECT")
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"))


def market_updates(lines: DataFrame) -> DataFrame:
    """venue, t, at, nth, kind, name, bid, ask, price, size, side: what recorded messages say, a row each.

    kind quote: a token's best bid and ask, from a book (highest bid, lowest ask) or from each change of price; trade: a
    print; volatility and index: a currency's level from a subscription. Other messages, and changes without both
    sides, give no row. at and nth order the messages of one time."""
    get = lambda path, kind="string": F.try_variant_get("m", path, kind)
    whole = lines.where((_kind(F.col("m")) == "OBJECT") & F.col("t").isNotNull())
    event, channel = get("$.event_type"), get("$.params.channel")
    prices = lambda side: F.transform(get(f"$.{side}", "array<variant>"), lambda x: F.try_variant_get(x, "$.price", "string").try_cast("double"))
    none = F.lit(None).cast("double")
    row = lambda kind, name, bid=none, ask=none, price=none, size=none, side=None: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), bid.alias("bid"), ask.alias("ask"), price.alias("price"), size.alias("size"), (F.lit(None).cast("string") if side is None else side).alias("side")
    )
    inner = lambda x, path: F.try_variant_get(x, path, "string")
    changed = F.transform(get("$.price_changes", "array<variant>"), lambda x: row("quote", inner(x, "$.asset_id"), inner(x, "$.best_bid").try_cast("double"), inner(x, "$.best_ask").try_cast("double")))
    changed = F.filter(changed, lambda x: x["name"].isNotNull() & x["bid"].isNotNull() & x["ask"].isNotNull())
    currency = F.upper(F.element_at(F.split(F.element_at(F.split(channel, r"\."), -1), "_"), 1))
    found = (
        F.when(event == "book", F.array(row("quote", get("$.asset_id"), F.array_max(prices("bids")), F.array_min(prices("asks")))))
        .when(event == "price_change", changed)
        .when(event == "last_trade_price", F.array(row("trade", get("$.asset_id"), price=get("$.price").try_cast("double"), size=F.coalesce(get("$.size").try_cast("double"), F.lit(0.0)), side=get("$.side"))))
        .when(channel.startswith("deribit_volatility_index"), F.array(row("volatility", currency, price=get("$.params.data.volatility").try_cast("double"))))
        .when(channel.startswith("deribit_price_index"), F.array(row("index", currency, price=get("$.params.data.price").try_cast("double"))))
    )
    return whole.select("venue", "t", "at", "nth", F.explode(found).alias("x")).select("venue", "t", "at", "nth", "x.*")
