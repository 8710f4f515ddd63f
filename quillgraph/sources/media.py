"""Pictures of entities and units: galleries with a preferred portrait, media merged onto other tables, seeds from a manifest of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import codes


def galleries(pictures: DataFrame, most: int = 12) -> DataFrame:
    """(name, gallery, avatar) from pictures (name, ord, src, source, solo), the first ``most`` by order and address.

    The portrait is the first that shows one person alone, else the first of the source ``commons``, else the first of all.
    Pictures without a name or an address don't count; equal addresses of a name count once, at their first place.
    """
    p = pictures.where("name IS NOT NULL AND src IS NOT NULL").groupBy("name", "src").agg(F.min_by(F.struct("ord", "source", "solo"), F.struct("ord", "source", "solo")).alias("p")).select("name", "src", "p.*")
    r = F.row_number().over(Window.partitionBy("name").orderBy("ord", "src"))
    kept = p.withColumn("r", r).where(F.col("r") <= most)
    grade = F.when(F.coalesce("solo", F.lit(False)), 0).when(F.coalesce("source", F.lit("")) == "commons", 1).otherwise(2)
    listed = F.sort_array(F.collect_list(F.struct("r", "src")))["src"].alias("gallery")
    return kept.groupBy("name").agg(listed, F.min_by("src", F.struct(grade, "r")).alias("avatar"))


def with_media(rows: DataFrame, media: DataFrame, key: str, value: str = "media") -> DataFrame:
    """``rows`` with the media (key, value) of their key in place of any they had; rows without lose what they had. Of several media the first by text counts."""
    found = media.select(F.col(key).alias("_key"), F.col(value).alias("_value")).groupBy("_key").agg(F.min("_value").alias("_value"))
    return rows.drop(value).join(found, F.col(key) == F.col("_key"), "left").withColumn(value, F.col("_value")).drop("_key", "_value")


def manifest_seeds(files: DataFrame, people: str = "") -> DataFrame:
    """(no, name, aliases, role, description): an entity for each converted file (no, title, code, category, converted, error) without an error.

    A standard is named by its code and has its title and its code without the year as aliases; any other file is named by its
    title, and a title that begins with the name of the state (``people``) has what follows as an alias. A year of edition in
    brackets at the end is no part of a title. Aliases have 2 to 40 characters and differ from the name.
    """
    ok = files.where(F.coalesce("converted", F.lit(False)) & (F.coalesce("error", F.lit("")) == ""))
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[（(]\d{4}\s*版[）)]$", ""))
    code = F.coalesce("code", F.lit(""))
    name = F.when(code != "", code).otherwise(title)
    base = F.when(codes.code_year(code) > 0, codes.code_base(code))
    short = F.when(F.lit(bool(people)) & title.startswith(people), F.substring(title, F.lit(len(people) + 1), F.length(title)))
    of = F.when(code != "", F.array(title, base)).otherwise(F.array(short))
    aliases = F.filter(F.array_distinct(F.array_compact(of)), lambda a: (a != name) & F.length(a).between(2, 40))
    return ok.select("no", name.alias("name"), aliases.alias("aliases"), F.col("category").alias("role"), F.when(code != "", title).otherwise("").alias("description")).where("name <> ''")


def seed_hints(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """(id, hint): for each text the seeds whose name or alias stands in it, a line each in the order of the seeds.

    ``seeds`` is (seed_id, name, entity_type, aliases), ``found`` the pairs (needle_id, hay_id) that ``contain.contained`` gives for its names and aliases.
    """
    also = F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.concat(F.lit(", also "), F.array_join("aliases", ", "))).otherwise("")
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")"), also)
    lines = found.select(F.col("hay_id").alias("id"), F.col("needle_id").alias("seed_id")).distinct().join(seeds.select("seed_id", line.alias("line")), "seed_id")
    return lines.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seed_id", "line")))["line"], "\n").alias("hint"))
