"""Pasted address lists: parsing, and matching against the members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.functions.text import email_of_line, email_of_recipient, normal_email, strip
from tertulia.plans.staging import stage
from tertulia.sources.tables import Tables

LONG, PIECE = 1_000_000, 20_000  # characters in a text that is cut, entries in a piece of it


def in_pieces(text: str, separator: str, entries: int = PIECE, longer: int = LONG) -> Column:
    """A text as an array of pieces of `entries` entries each, without the separators between pieces; texts of
    at most `longer` characters are one. A missing text has no pieces."""
    several = F.regexp_extract_all(F.concat(text, F.lit(separator)), F.lit(f"(?:[^{separator}]*+{separator}){{1,{entries}}}+"), F.lit(0))
    cut = F.transform(several, lambda piece: F.left(piece, F.length(piece) - 1))
    return F.when(F.length(text) > longer, cut).when(F.col(text).isNotNull(), F.array(text))


def _entries(df: DataFrame, text_col: str, separator: str, spread: bool) -> tuple[list[str], DataFrame]:
    keys = [c for c in df.columns if c != text_col]
    pieces = df.select(*keys, F.posexplode(in_pieces(text_col, separator)).alias("_nth", "_piece"))
    if spread:
        pieces = pieces.repartition(*keys, "_nth")
    return keys, pieces.select(*keys, F.explode(F.split("_piece", separator)).alias("_entry"))


def parse_email_lines(df: DataFrame, text_col: str = "texto", drop_cr: bool = True, spread: bool = False) -> DataFrame:
    """One address per line: drop blank lines, clean, lower-case, de-duplicate per batch.

    All columns but `text_col` identify the batch. `drop_cr=False` leaves a carriage return
    inside an address, as the course forms do. Texts are cut into pieces, so no array holds more than one
    piece's lines; `spread` deals the pieces to tasks, for input in which one text has a large share. That
    moves all texts once.
    """
    keys, lines = _entries(df, text_col, "\n", spread)
    filled = lines.where(strip(F.col("_entry")) != "")
    return filled.select(*keys, email_of_line(F.col("_entry"), drop_cr).alias("correo")).distinct()


def parse_reply_all(df: DataFrame, text_col: str = "texto", keep_blank: bool = False, spread: bool = False) -> DataFrame:
    """A mail client's recipient list, `Name <address>; ...`, de-duplicated per batch; `spread` as above."""
    keys, entries = _entries(df, text_col, ";", spread)
    emails = entries.select(*keys, email_of_recipient(F.col("_entry")).alias("correo"))
    return (emails if keep_blank else emails.where("correo <> ''")).distinct()


def _member_emails(t: Tables, normalize: bool) -> DataFrame:
    correo = normal_email(F.col("correo")) if normalize else F.col("correo")
    return t.comunidad.select(correo.alias("correo"), "id_usuario")


def known_emails(t: Tables, emails: DataFrame, normalize: bool = False) -> DataFrame:
    """Addresses that belong to a member. `normalize` also cleans the stored address."""
    return emails.join(_member_emails(t, normalize), "correo", "left_semi").select(*emails.columns)


def unknown_emails(t: Tables, emails: DataFrame, normalize: bool = False) -> DataFrame:
    """Addresses that belong to no member yet."""
    return emails.join(_member_emails(t, normalize), "correo", "left_anti").select(*emails.columns)


def resolve_members(
    t: Tables, emails: DataFrame, first_only: bool = True, normalize: bool = False
) -> DataFrame:
    """`emails` with the member's id. Of members that share an address, the lowest id, or all.

    The lowest ids of the addresses at hand are staged before the join, so an address that many
    members share is never paired with every batch that names it.
    """
    members = _member_emails(t, normalize)
    if first_only:
        wanted = emails.select("correo").distinct()
        lowest = members.groupBy("correo").agg(F.min("id_usuario").alias("id_usuario"))
        members = stage(lowest.join(wanted, "correo", "left_semi"))
    return emails.join(members, "correo").select(*emails.columns, "id_usuario")
