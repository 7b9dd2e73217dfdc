"""The most restrictive licence of a set of components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Restrictiveness of each licence, and other spellings of their names.
RANKS = (
    ("Public Domain", 0), ("CC0", 0), ("MIT", 1), ("Apache-2.0", 1), ("BSD-3-Clause", 1), ("MPL 2.0", 2), ("LGPL-3.0", 3),
    ("GPL-3.0", 4), ("AGPL-3.0", 4), ("CC BY 4.0", 1), ("CC BY-SA 4.0", 3), ("CC BY-NC 4.0", 5), ("CC BY-NC-SA 4.0", 6),
    ("glm-4", 5),
)
ALIASES = (
    ("apache 2.0", "Apache-2.0"), ("apache license 2.0", "Apache-2.0"), ("mit license", "MIT"), ("mpl-2.0", "MPL 2.0"),
    ("gpl 3.0", "GPL-3.0"), ("gpl-3.0 license", "GPL-3.0"), ("agpl 3.0", "AGPL-3.0"), ("agpl-3.0 license", "AGPL-3.0"),
    ("agplv3", "AGPL-3.0"), ("gnu affero general public license v3.0", "AGPL-3.0"), ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"), ("attribution-noncommercial 4.0 international", "CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"), ("attribution-noncommercial-sharealike 4.0 international", "CC BY-NC-SA 4.0"),
    ("glm4", "glm-4"), ("glm-4 license", "glm-4"),
)
WORST = max(r for _, r in RANKS)
# Where the terms of each licence stand.
URLS = {
    "Public Domain": "https://creativecommons.org/publicdomain/mark/1.0/", "CC0": "https://creativecommons.org/publicdomain/zero/1.0/",
    "MIT": "https://opensource.org/license/mit/", "Apache-2.0": "https://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "https://opensource.org/license/bsd-3-clause/", "MPL 2.0": "https://www.mozilla.org/en-US/MPL/2.0/",
    "LGPL-3.0": "https://www.gnu.org/licenses/lgpl-3.0.html", "GPL-3.0": "https://www.gnu.org/licenses/gpl-3.0.html",
    "AGPL-3.0": "https://www.gnu.org/licenses/agpl-3.0.html", "CC BY 4.0": "https://creativecommons.org/licenses/by/4.0/",
    "CC BY-SA 4.0": "https://creativecommons.org/licenses/by-sa/4.0/", "CC BY-NC 4.0": "https://creativecommons.org/licenses/by-nc/4.0/",
    "CC BY-NC-SA 4.0": "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "glm-4": "https://huggingface.co/THUDM/glm-4v-9b/blob/main/LICENSE",
}
#: The licence of outputs of which no component is known.
CONSERVATIVE = "CC BY-NC 4.0"


def ranks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, r, URLS[n]) for n, r in RANKS], "license string, rank int, license_url string")


def aliases(spark: SparkSession) -> DataFrame:
    """Lower-case spelling -> canonical name."""
    return spark.createDataFrame([*ALIASES, *[(n.lower(), n) for n, _ in RANKS]], "alias string, canonical string")


def normalised(components: DataFrame) -> DataFrame:
    """Components with the canonical name of their licence, its rank and ``license_url``; an unknown one keeps its name and has
    rank -1 and no address."""
    spark = components.sparkSession
    named = components.withColumn("_key", F.lower(F.trim("license"))).join(
        F.broadcast(aliases(spark)), F.col("_key") == F.col("alias"), "left"  # a constant table
    )
    named = named.withColumn("license", F.coalesce("canonical", F.trim("license"), F.lit(""))).drop("_key", "alias", "canonical")
    return named.join(F.broadcast(ranks(spark)), "license", "left").withColumns(
        {"rank": F.coalesce("rank", F.lit(-1)), "license_url": F.coalesce("license_url", F.lit(""))}
    )


def distinct_components(components: DataFrame, keys: list[str]) -> DataFrame:
    """Each (name, licence) of a group once, at its first place."""
    return components.groupBy(*keys, "name", "license", "rank").agg(F.min("ord").alias("ord"))


def effective(components: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: the licence of the first component of the highest rank (unknown ones count as the highest there is), who
    determines it, the number of components and the unknown licences."""
    weighed = components.withColumn("weight", F.when(F.col("rank") < 0, WORST).otherwise(F.col("rank")))
    items = F.sort_array(F.collect_list(F.struct("ord", "name", "license", "weight", "rank")))
    grouped = weighed.groupBy(*keys).agg(items.alias("items"), F.max("weight").alias("worst"))
    top = F.filter("items", lambda x: x["weight"] == F.col("worst"))
    unknown = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x["rank"] < 0), lambda x: x["license"])))
    return grouped.select(
        *keys,
        top[0]["license"].alias("effective_license"),
        F.array_join(F.transform(top, lambda x: x["name"]), ",").alias("determined_by"),
        F.size("items").alias("n_components"),
        F.array_join(unknown, ",").alias("unknown_licenses"),
    )

# Licences that forbid commercial use, and that ask for the same terms.
NON_COMMERCIAL = ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "glm-4")
SHARE_ALIKE = ("CC BY-SA 4.0", "CC BY-NC-SA 4.0", "GPL-3.0", "AGPL-3.0", "LGPL-3.0", "MPL 2.0")


def flagged(effective_rows: DataFrame) -> DataFrame:
    """Effective licences with ``is_non_commercial`` and ``is_share_alike``; groups without components are MIT."""
    name = F.coalesce("effective_license", F.lit("MIT"))
    return effective_rows.withColumn("effective_license", name).withColumns(
        {"is_non_commercial": name.isin(*NON_COMMERCIAL), "is_share_alike": name.isin(*SHARE_ALIKE)}
    )


def notes(flagged_rows: DataFrame) -> DataFrame:
    """A sentence on each licence for readers, with its consequences and what was not recognised."""
    unknown = F.coalesce("unknown_licenses", F.lit(""))
    text = F.concat_ws(
        " ",
        F.concat(F.lit("The output licence is "), "effective_license", F.lit(", the most restrictive of "), F.col("n_components").cast("string"), F.lit(" component(s).")),
        F.when(F.col("is_non_commercial"), "Commercial use is not permitted."),
        F.when(F.col("is_share_alike"), "Derivatives must carry the same terms."),
        F.when(unknown != "", F.concat(F.lit("Not recognised and treated as most restrictive: "), F.replace(unknown, F.lit(","), F.lit(", ")), F.lit("."))),
    )
    return flagged_rows.withColumn("notes", text)


def licensed(groups: DataFrame, effective_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every one of ``groups`` with its effective licence, flags and address; one without components gets ``CONSERVATIVE``."""
    spark = groups.sparkSession
    rows = groups.select(*keys).distinct().join(effective_rows, keys, "left")
    rows = flagged(rows.withColumn("effective_license", F.coalesce("effective_license", F.lit(CONSERVATIVE))))
    urls = ranks(spark).select(F.col("license").alias("effective_license"), F.col("license_url").alias("effective_license_url"))
    out = rows.join(F.broadcast(urls), "effective_license", "left")  # a constant table
    return out.withColumns({"effective_license_url": F.coalesce("effective_license_url", F.lit("")), "n_components": F.coalesce("n_components", F.lit(0))})


def united(prior: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """The components a record already names and those a tool adds, each (name, licence) once, the prior ones first."""
    step = lambda df, n: df.select(*keys, "name", "license", "rank", F.struct(F.lit(n).alias("step"), "ord").alias("ord"))
    return distinct_components(step(prior, 0).unionByName(step(added, 1)), keys)


#: What each kind of backend brings into a run, without and with a glossary.
BACKEND_COMPONENTS = {
    "form": (("translation_service",), ("lemma_engine", "lemma_models", "glossary_terms", "glossary_data")),
    "chat": (("chat_service",), ("glossary_terms", "glossary_data")),
    "identity": ((), ()), "prefix": ((), ()), "dictionary": ((), ("glossary_terms",)),
}


def backend_components(backend: str, with_glossary: bool = False) -> list[str]:
    """The names of the components a backend contributes."""
    own, more = BACKEND_COMPONENTS.get(backend, ((), ()))
    return [*own, *(more if with_glossary else ())]
