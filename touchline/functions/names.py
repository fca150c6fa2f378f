"""Names of players, teams and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded by fold_accents, pairwise.
ACCENTED = "áàâäãåčćçďéèêëěíìîïňñóòôöõøřšťúùûüůýžÁÀÂÄÃÅČĆÇĎÉÈÊËĚÍÌÎÏŇÑÓÒÔÖÕØŘŠŤÚÙÛÜŮÝŽ"
PLAIN = "aaaaaacccdeeeeeiiiinnoooooorstuuuuuyzAAAAAACCCDEEEEEIIIINNOOOOOORSTUUUUUYZ"


def surname(name: Column) -> Column:
    """Last whitespace-separated word in lower case; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(name, r"(\S+)\s*$", 1)), F.lit(""))


def short_surname(name: Column) -> Column:
    """Last word with its case kept, for running text."""
    return F.regexp_extract(name, r"(\S+)\s*$", 1)


def fold_accents(name: Column) -> Column:
    return F.translate(name, ACCENTED, PLAIN)


def alike(name: Column) -> Column:
    """The name as one that equals others whatever their case and accents, in joins and groups too."""
    return F.collate(name, "UNICODE_CI_AI")


def initials(team: Column) -> Column:
    """One word gives its first three letters, more give up to three initials."""
    words = F.filter(F.split(F.translate(team, "'.", ""), r"\s+"), lambda w: w != "")
    letters = F.transform(F.slice(words, 1, 3), lambda w: F.substring(w, 1, 1))
    return F.upper(
        F.when(F.size(words) == 1, F.substring(F.get(words, F.lit(0)), 1, 3)).otherwise(
            F.array_join(letters, "")
        )
    )


def _file_part(team: Column) -> Column:
    return F.replace(F.replace(team, F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def asset_name(home: Column, away: Column, content_type: Column, idx: Column) -> Column:
    """File name under which the audio of one text is stored."""
    return F.concat(
        _file_part(home), F.lit("_vs_"), _file_part(away), F.lit("_"),
        content_type, F.lit("_"), idx.cast("string"), F.lit(".mp3"),
    )


def shorten(name: Column, limit: int = 30, keep: int = 28) -> Column:
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, keep), F.lit("…"))).otherwise(name)
