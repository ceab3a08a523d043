"""Team identities: a waterfall of lookups from a provider's name to a canonical id, which fails closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strictbefore.functions import text

# Words that a name may drop within one league.
LEAGUE_NOISE = ("fc", "cf", "bsc", "afc", "sv", "sc", "fk", "sk", "cd", "ud", "rcd", "rc", "as", "ss", "us")


def stripped(name):
    """A normalised name without its league's noise words."""
    return F.array_join(text.without(text.words(text.team_name(name)), LEAGUE_NOISE), " ")


def unique(names: DataFrame, *keys: str) -> DataFrame:
    """The canonical id of each key that stands for one id only."""
    got = names.groupBy(*keys).agg(F.min("canonical_id").alias("found"), F.max("canonical_id").alias("_last"))
    return got.filter("found = _last").drop("_last")


def resolve(raw: DataFrame, identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """raw (name, provider, provider_team_id, league_id, ...) with canonical_id and the step that found it.

    identities: provider, provider_team_id, normalized_name, league_id, canonical_id; aliases: alias, canonical_id. In order: the
    provider's stored id, if its name agrees; the name, unique; an alias; the name without a national suffix; the name without
    the league's noise words, unique in the league; else null. Names are looked up once per distinct name.
    """
    rows = raw.withColumn("_name", text.team_name(F.col("name")))
    by_id = identities.select(F.col("provider").alias("_p"), F.col("provider_team_id").alias("_pid"), F.col("normalized_name").alias("_stored"), F.col("canonical_id").alias("_by_id")).dropDuplicates(["_p", "_pid"])
    rows = rows.join(by_id, (F.col("provider") == F.col("_p")) & (F.col("provider_team_id") == F.col("_pid")), "left")
    names = rows.select("_name", "league_id").distinct().withColumn("_national", text.national_name(F.col("_name"))).withColumn("_short", stripped(F.col("_name")))
    exact = unique(identities.withColumnRenamed("normalized_name", "_n"), "_n")
    alias = unique(aliases.select(text.team_name(F.col("alias")).alias("_n"), "canonical_id"), "_n")
    short = unique(identities.withColumn("_n", stripped(F.col("normalized_name"))).withColumnRenamed("league_id", "_league"), "_n", "_league")
    look = lambda df, table, key, out: df.join(table.select(F.col("_n").alias(f"_k{out}"), F.col("found").alias(out)), F.col(key) == F.col(f"_k{out}"), "left").drop(f"_k{out}")
    names = look(look(look(names, exact, "_name", "_exact"), alias, "_name", "_alias"), exact, "_national", "_nat")
    names = names.join(short.select(F.col("_n").alias("_ks"), "_league", F.col("found").alias("_brief")), (F.col("_short") == F.col("_ks")) & (F.col("league_id") == F.col("_league")), "left")
    names = names.select(F.col("_name").alias("_n2"), F.col("league_id").alias("_l2"), "_exact", "_alias", "_nat", "_brief")
    got = rows.join(names, (F.col("_name") == F.col("_n2")) & F.col("league_id").eqNullSafe(F.col("_l2")), "left")
    stored = F.col("_by_id").isNotNull()
    agrees = stored & (F.col("_stored") == F.col("_name"))
    blank = F.col("_name") == ""
    steps = [("provider_id", F.col("_by_id")), ("name", F.col("_exact")), ("alias", F.col("_alias")), ("national", F.col("_nat")), ("league", F.col("_brief"))]
    later = F.coalesce(*[c for _, c in steps[1:]])
    canonical = F.when(blank | (stored & ~agrees), None).when(agrees, F.col("_by_id")).otherwise(later)
    step = F.when(agrees, "provider_id")
    for name, col in steps[1:]:
        step = step.when(col.isNotNull(), name)
    return got.select(*raw.columns, canonical.alias("canonical_id"), F.when(canonical.isNotNull(), step).alias("step"))


def mint(unresolved: DataFrame, sport: str) -> DataFrame:
    """New identities for names that nothing resolves: one per slug, with the provider's id or one made from league and name."""
    rows = unresolved.withColumn("normalized_name", text.team_name(F.col("name"))).filter("normalized_name != ''")
    own = F.coalesce(F.col("provider_team_id").cast("string"), F.concat_ws(":", F.lit("name"), F.coalesce(F.col("league_id").cast("string"), F.lit("")), F.col("normalized_name")))
    rows = rows.select("provider", own.alias("provider_team_id"), "normalized_name", "league_id", F.concat(F.lit(f"{sport}_team_"), text.slug(F.col("name"))).alias("canonical_id"), F.col("name").alias("display_name"))
    first = Window.partitionBy("provider", "provider_team_id").orderBy("normalized_name", "display_name")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
