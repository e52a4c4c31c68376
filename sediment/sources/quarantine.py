"""Rows with a JSON text, split into good ones and faults with their reasons, which can be repaired and replayed.

Nothing is thrown away: each row is in the log under its key, with the parsed values or with the reasons why there are none. Good rows and faults of a
batch are published in one step (sediment.sources.log), and a batch that is run again isn't counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sediment.sources.log import Log

_CORRUPT = "_corrupt"


def parsed(text: Column, schema: str, mode: str = "PERMISSIVE") -> Column:
    """A JSON text as a struct; with PERMISSIVE, _corrupt holds a text that is broken or has a value of another type. FAILFAST ends the job there."""
    fields = StructType.fromDDL(schema)
    if mode == "PERMISSIVE":
        fields = StructType([*fields.fields, StructField(_CORRUPT, StringType())])
    return F.from_json(text, fields, {"mode": mode, "columnNameOfCorruptRecord": _CORRUPT})


def judged(rows: DataFrame, text: str, schema: str, rules: dict[str, str], into: str = "value") -> DataFrame:
    """rows with into, the parsed text, and reasons: missing or broken, else the rules that the row breaks (null is broken). Rules are SQL conditions over rows' columns and into's fields."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    found = rows.withColumn(into, F.when(~blank, parsed(F.col(text), schema)))
    broken = ~blank & (F.col(into)[_CORRUPT].isNotNull() | ~F.regexp_like(text, F.lit(r"^\s*\{")))
    whole = ~blank & ~broken
    named = [F.when(blank, "missing"), F.when(broken, "broken"), *(F.when(whole & ~F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in rules.items())]
    found = found.withColumn("reasons", F.filter(F.array(*named), lambda x: x.isNotNull()))
    return found.withColumn(into, F.when(whole, F.col(into).dropFields(_CORRUPT)))


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, faults) of judged()."""
    return found.where(F.size("reasons") == 0).drop("reasons"), found.where(F.size("reasons") > 0)


def strict(rows: DataFrame, text: str, schema: str, into: str = "value") -> DataFrame:
    """rows with the parsed text; the first broken one ends the job."""
    return rows.withColumn(into, parsed(F.col(text), schema, "FAILFAST"))


class Quarantine:
    """Batches of rows with a key and a JSON text. A row that comes again under its key takes the place of the one before."""

    def __init__(self, log: Log, text: str, schema: str, rules: dict[str, str]):
        self.log, self.text, self.schema, self.rules = log, text, schema, rules

    def _publish(self, rows: DataFrame, notes: dict) -> int:
        one = rows.dropDuplicates([self.log.key])
        return self.log.append(judged(one, self.text, self.schema, self.rules), self.log.version(), notes)

    def ingest(self, rows: DataFrame, batch: int) -> int:
        """For foreachBatch: the version with this batch in it. Rows without a key are refused with the batch, as nothing could tell them apart."""
        done = self.log.manifest()["notes"].get("batch", -1)
        return self.log.version() if batch <= done else self._publish(rows.withColumn("attempts", F.lit(1)), {"batch": batch})

    def replay(self, repaired: DataFrame) -> int:
        """repaired: key and text of some faults. They are judged again; those that are still faulty stay, with one attempt more. Keys that aren't faults are left alone."""
        faults = self.faults().drop("value", "reasons").join(repaired.select(self.log.key, F.col(self.text).alias("_new")), self.log.key)
        return self._publish(faults.withColumn(self.text, F.col("_new")).withColumn("attempts", F.col("attempts") + 1).drop("_new"), {})

    def good(self) -> DataFrame:
        return split(self.log.read())[0]

    def faults(self) -> DataFrame:
        return split(self.log.read())[1]
