"""Roles of persons: whether they are anonymised and by which placeholder. A fixed table of 21 rows, always broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: role: (anonymised by default, placeholder prefix). Fixed values.
ROLES: dict[str, tuple[bool, str | None]] = {
    "PARTE_ACTORA": (True, "ACTOR"),
    "PARTE_DEMANDADA": (True, "DEMANDADO"),
    "TERCERO_CITADO": (True, "TERCERO"),
    "TESTIGO": (True, "TESTIGO"),
    "VICTIMA": (True, "VICTIMA"),
    "MENOR": (True, "MENOR"),
    "FAMILIAR_DE_PARTE": (True, "FAMILIAR"),
    "LETRADO_PATROCINANTE": (True, "LETRADO"),
    "LETRADO_APODERADO": (True, "LETRADO"),
    "JUEZ": (False, None),
    "FISCAL": (False, None),
    "DEFENSOR_OFICIAL": (False, None),
    "SECRETARIO": (False, None),
    "PERITO_OFICIAL": (False, None),
    "PERITO_DE_PARTE": (True, "PERITO"),
    "AUTOR_DOCTRINA": (False, None),
    "AUTOR_JURISPRUDENCIA": (False, None),
    "FUNCIONARIO_PUBLICO": (False, None),
    "ENTIDAD_PUBLICA": (False, None),
    "ENTIDAD_PRIVADA": (False, None),
    "DESCONOCIDO": (True, "PERSONA"),
}
UNKNOWN = "DESCONOCIDO"
#: Prefix of a role that is anonymised only by an override.
FALLBACK_PREFIX = "ENTIDAD"


def policy(spark: SparkSession, overrides: dict[str, bool] | None = None) -> DataFrame:
    """role, anonymize, prefix. An override of an unknown role is an error; one that turns anonymising on gets a prefix."""
    overrides = overrides or {}
    if unknown := set(overrides) - set(ROLES):
        raise KeyError(f"unknown roles: {sorted(unknown)}")
    rows = [(r, overrides.get(r, a), p or (FALLBACK_PREFIX if overrides.get(r) else None)) for r, (a, p) in ROLES.items()]
    return spark.createDataFrame(rows, "role string, anonymize boolean, prefix string")


def parse_role(said: Column) -> Column:
    """The role that was said, blanks and case aside; anything else is unknown. Never null, never an error."""
    r = F.upper(F.trim(said))
    return F.when(r.isin(*ROLES), r).otherwise(F.lit(UNKNOWN))


def with_policy(rows: DataFrame, table: DataFrame, role: str = "role") -> DataFrame:
    return rows.join(F.broadcast(table.select(F.col("role").alias(role), "anonymize", "prefix")), role, "left")


def placeholder(prefix: Column, n: Column) -> Column:
    return F.when(prefix.isNotNull(), F.concat(F.lit("["), prefix, F.lit("_"), n.cast("string"), F.lit("]")))
