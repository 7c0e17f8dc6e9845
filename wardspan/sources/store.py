"""Tables of a federated run that grow round by round, so that a killed run goes on where it stopped.

Every write replaces just its own rounds (dynamic partition overwrite) and is marked as whole afterwards. Rounds without
a mark are computed again, whatever their files hold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.sources.files import claim_file, names_in, put_file, read_file
from wardspan.specs import RunSettings, SiteSpec

KEYS = ["model", "part", "round"]
#: Settings that may differ when a run goes on.
FREE = ("lr_rounds", "nn_rounds")


def settings_text(settings: RunSettings) -> str:
    return json.dumps(asdict(settings), sort_keys=True)


def settings_from(text: str) -> RunSettings:
    given = json.loads(text)
    given["sites"] = tuple(SiteSpec(**site) for site in given["sites"])
    given["features"] = tuple(given["features"])
    return RunSettings(**given)


class RunStore:
    """The folder of one run. Opening it with other settings than it was begun with raises ValueError."""

    def __init__(self, spark: SparkSession, root: str, settings: RunSettings):
        self.spark, self.root = spark, root.rstrip("/")
        known = read_file(spark, f"{self.root}/settings.json")
        if known is None:
            put_file(spark, f"{self.root}/settings.json", settings_text(settings))
            known = settings_text(settings)
        before, now = json.loads(known), json.loads(settings_text(settings))
        changed = sorted(name for name in now if name not in FREE and before.get(name) != now[name])
        if changed:
            raise ValueError(f"{self.root} holds a run with other settings: {', '.join(changed)}")

    def _marks(self, table: str, model: str, part: str, basis: str) -> str:
        return f"{self.root}/done/{table}/{model}/{part}/{basis}"

    def done(self, table: str, model: str, part: str, basis: str = "all") -> set[int]:
        """Rounds written as a whole. `basis` names what they were computed from besides the settings."""
        return {int(name) for name in names_in(self.spark, self._marks(table, model, part, basis)) if name.isdigit()}

    def write(self, table: str, rows: DataFrame, model: str, part: str, rounds: Sequence[int], basis: str = "all") -> None:
        """Replace the given rounds by `rows`, which have a column `round`."""
        keyed = rows.withColumns({"model": F.lit(model), "part": F.lit(part)})
        writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS)
        writer.parquet(f"{self.root}/{table}")
        for round_no in rounds:
            claim_file(self.spark, f"{self._marks(table, model, part, basis)}/{round_no}")

    def read(self, table: str) -> DataFrame:
        """All rounds in the folder, with the columns model, part and round."""
        return self.spark.read.parquet(f"{self.root}/{table}")

    def rounds(
        self,
        table: str,
        model: str,
        part: str,
        rounds: Sequence[int],
        build: Callable[[list[int]], DataFrame],
        basis: str = "all",
    ) -> DataFrame:
        """The rows of some rounds; `build` makes those that are not there yet."""
        missing = [r for r in rounds if r not in self.done(table, model, part, basis)]
        if missing:
            self.write(table, build(missing), model, part, missing, basis)
        here = (F.col("model") == model) & (F.col("part") == part) & F.col("round").isin(list(rounds))
        return self.read(table).where(here).drop("part")
