"""Raw files of futures data: their commodity by the symbol before the first underscore, and the folder they belong in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbol to folder and name (fixed values).
COMMODITIES = {
    "HG": ("copper", "Copper"), "GC": ("gold", "Gold"), "SI": ("silver", "Silver"), "PL": ("platinum", "Platinum"), "PA": ("palladium", "Palladium"), "ALI": ("aluminum", "Aluminum"),
    "CL": ("crude_oil", "Crude Oil WTI"), "BZ": ("brent_crude", "Brent Crude"), "NG": ("natural_gas", "Natural Gas"), "HO": ("heating_oil", "Heating Oil"), "RB": ("gasoline", "RBOB Gasoline"),
    "ZC": ("corn", "Corn"), "ZW": ("wheat", "Wheat"), "ZS": ("soybeans", "Soybeans"), "ZL": ("soybean_oil", "Soybean Oil"), "ZM": ("soybean_meal", "Soybean Meal"), "ZO": ("oats", "Oats"), "ZR": ("rice", "Rice"),
    "SB": ("sugar", "Sugar"), "KC": ("coffee", "Coffee"), "CC": ("cocoa", "Cocoa"), "CT": ("cotton", "Cotton"), "OJ": ("orange_juice", "Orange Juice"),
    "LE": ("live_cattle", "Live Cattle"), "HE": ("lean_hogs", "Lean Hogs"), "GF": ("feeder_cattle", "Feeder Cattle"),
    "AD": ("currencies", "Australian Dollar"), "A6": ("currencies", "Australian Dollar (micro)"), "DX": ("currencies", "US Dollar Index"), "CNH": ("currencies", "Offshore RMB"), "JY": ("currencies", "Japanese Yen"),
    "PJY": ("currencies", "Japanese Yen (mini)"), "NOK": ("currencies", "Norwegian Krone"), "SEK": ("currencies", "Swedish Krona"), "KRW": ("currencies", "Korean Won"), "PRK": ("currencies", "Polish Zloty"), "TWN": ("currencies", "Taiwan Dollar"),
    "ES": ("equity_indices", "E-mini S&P 500"), "MES": ("equity_indices", "Micro E-mini S&P 500"), "NQ": ("equity_indices", "E-mini NASDAQ-100"), "MNQ": ("equity_indices", "Micro E-mini NASDAQ-100"), "YM": ("equity_indices", "E-mini Dow"),
    "RTY": ("equity_indices", "E-mini Russell 2000"), "NK": ("equity_indices", "Nikkei 225 (USD)"), "NKD": ("equity_indices", "Nikkei 225 (Yen)"), "NIY": ("equity_indices", "Nikkei 225 Yen"),
    "ZN": ("fixed_income", "10-Year T-Note"), "ZB": ("fixed_income", "30-Year T-Bond"), "ZF": ("fixed_income", "5-Year T-Note"), "ZT": ("fixed_income", "2-Year T-Note"), "ZQ": ("fixed_income", "30-Day Fed Funds"),
    "UB": ("fixed_income", "Ultra T-Bond"), "TN": ("fixed_income", "Ultra 10-Year"),
    "BTC": ("crypto", "Bitcoin"), "MBT": ("crypto", "Micro Bitcoin"), "ETH": ("crypto", "Ethereum"), "MET": ("crypto", "Micro Ether"), "VX": ("volatility", "VIX Futures"), "VXM": ("volatility", "Mini VIX"),
}


def classify_files(files: DataFrame) -> DataFrame:
    """files (filename, ...) with symbol, commodity, category; unknown symbols are UNKNOWN, Unknown, other."""
    dim = files.sparkSession.createDataFrame([(s, c, n) for s, (c, n) in COMMODITIES.items()], "_symbol string, _category string, _name string")
    known = files.join(F.broadcast(dim), F.element_at(F.split("filename", "_"), 1) == F.col("_symbol"), "left")  # the table above
    return known.withColumns({"symbol": F.coalesce("_symbol", F.lit("UNKNOWN")), "commodity": F.coalesce("_name", F.lit("Unknown")), "category": F.coalesce("_category", F.lit("other"))}).drop("_symbol", "_name", "_category")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """filename, symbol, commodity, category, size_mb of the .txt files right in a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "length")
    named = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), F.format_string("%.2f", F.col("length") / (1 << 20)).alias("size_mb"))
    return classify_files(named).select("filename", "symbol", "commodity", "category", "size_mb").orderBy("category", "symbol", "filename")


def organise(spark: SparkSession, source: str, destination: str, dry_run: bool = False) -> DataFrame:
    """inventory(source); unless dry_run, files move to a folder of their category in destination, unless one of their name is there. One rename per file, by the file system."""
    listed = inventory(spark, source)
    rows = listed.collect()  # names of files in one folder, which the file system lists at the driver too
    out = spark.createDataFrame(rows, listed.schema)
    if dry_run:
        return out
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows:
        target = path(f"{destination}/{r['category']}/{r['filename']}")
        fs.mkdirs(target.getParent())
        if not fs.exists(target):
            fs.rename(path(f"{source}/{r['filename']}"), target)
    return out
