"""Identifiers: encoded post ids, references, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How encoded ids begin, the site, and the patterns of ids below.
ENCODED = "Uzpf"
SITE = "https://www.facebook.com"


def _parts(encoded: Column) -> Column:
    """Colon-separated parts of a base64 id, with or without padding; bad bytes are replaced, bad base64 gives null."""
    bare = F.regexp_replace(encoded, "=+$", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    return F.split(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), ":")


def decode_id(encoded: Column) -> Column:
    """``author, post`` of an encoded id: the last ``_I…`` part and the last part of more than eight digits."""
    author = F.try_element_at(F.filter(_parts(encoded), lambda p: p.startswith("_I")), F.lit(-1))
    post = F.try_element_at(F.filter(_parts(encoded), lambda p: p.rlike(r"^\d{9,}$")), F.lit(-1))
    return F.struct(F.substring(author, F.lit(3), F.length(author)).alias("author"), post.alias("post"))


def first_post(encoded: Column) -> Column:
    """The first part of more than eight digits."""
    return F.try_element_at(F.filter(_parts(encoded), lambda p: p.rlike(r"^\d{9,}$")), F.lit(1))


def reference_id(reference: Column, group: str | None = None) -> Column:
    """The post a reference names: an encoded id, else the number after ``posts/`` or ``permalink/``, else the last long number that isn't the group's."""
    reference = F.trim(reference)
    after = F.nullif(F.regexp_extract(reference, r"(?:posts|permalink)/(\d{8,})", 1), F.lit(""))
    numbers = F.regexp_extract_all(reference, F.lit(r"(\d{8,})"), 1)
    if group:
        numbers = F.filter(numbers, lambda n: n != group)
    return F.coalesce(F.when(reference.startswith(ENCODED), first_post(reference)), after, F.try_element_at(numbers, F.lit(-1)))


def group_of(url: Column) -> Column:
    """The number after ``/groups/``, or an empty string."""
    return F.regexp_extract(url, r"/groups/(\d+)", 1)


def post_url(group: Column | str, post: Column, site: str = SITE) -> Column:
    group = F.lit(group) if isinstance(group, str) else group
    return F.when(post.isNotNull() & (post != ""), F.concat(F.lit(f"{site}/groups/"), group, F.lit("/posts/"), post, F.lit("/")))


def author_url(author: Column, site: str = SITE) -> Column:
    return F.when(author.isNotNull() & (author != ""), F.concat(F.lit(f"{site}/"), author))


def chosen_url(www: Column, url: Column, group: Column | str, post: Column, site: str = SITE) -> Column:
    """The post's own address; one is put together where the number is known and the address names no post."""
    own = F.coalesce(F.nullif(www, F.lit("")), F.nullif(url, F.lit("")))
    return F.when(post.isNotNull() & ~F.contains(F.coalesce(own, F.lit("")), F.lit("/posts/")), post_url(group, post, site)).otherwise(own)
