"""Person names: one canonical spelling for joins between sources."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Long first name -> short form used as the key.
NICKNAMES = {
    "matthew": "matt", "michael": "mike", "thomas": "tom", "tommy": "tom", "timothy": "tim",
    "william": "will", "robert": "rob", "vincent": "vince", "stephen": "steve", "steven": "steve",
    "nathaniel": "nate", "nicholas": "nick", "joshua": "josh", "jonathan": "jon", "christopher": "chris",
    "alexander": "alex", "daniel": "dan", "gregory": "greg", "benjamin": "ben", "zachary": "zach",
    "samuel": "sam", "edward": "ed", "joseph": "joe", "andrew": "andy", "anthony": "tony",
    "richard": "rich", "james": "jim", "charles": "charlie",
}


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition."""
    src, dst = [], []
    for code in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(s: Column) -> Column:
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(s, src, dst), r"[^\x00-\x7F]", "")


def _latin1_as_utf8(s: Column) -> Column:
    return F.try_validate_utf8(F.encode(s, "ISO-8859-1").cast("string"))


def repair_mojibake(s: Column) -> Column:
    """Undo UTF-8 bytes that were read as Latin-1; other text stays as it is."""
    latin = s.rlike(r"^[\x00-\xFF]*$") & s.rlike(r"[\x80-\xFF]")
    return F.when(latin, F.coalesce(_latin1_as_utf8(s), s)).otherwise(s)


def repair_escapes(s: Column) -> Column:
    r"""Turn literal ``\xNN`` runs back into the UTF-8 text they stand for."""
    raw = F.aggregate(
        F.regexp_extract_all(s, F.lit(r"(?s)(\\x[0-9a-fA-F]{2}|.)"), F.lit(1)),
        F.unhex(F.lit("")),
        lambda acc, tok: F.concat(acc, F.when(tok.rlike(r"^\\x[0-9a-fA-F]{2}$"), F.unhex(F.substring(tok, 3, 2)))
                                  .otherwise(F.encode(tok, "ISO-8859-1"))),
    )
    fits = s.contains("\\x") & s.rlike(r"^[\x00-\xFF]*$")
    return F.when(fits, F.coalesce(F.try_validate_utf8(raw.cast("string")), s)).otherwise(s)


def normalize_person_name(name: Column) -> Column:
    s = F.lower(strip_accents(repair_mojibake(repair_escapes(F.trim(name)))))
    swapped = F.when(s.contains(","), F.concat_ws(
        " ", F.trim(F.regexp_extract(s, r"^[^,]*,(.*)$", 1)), F.trim(F.regexp_extract(s, r"^([^,]*),", 1)))).otherwise(s)
    bare = F.regexp_replace(swapped, r"\s(jr|sr|ii|iii|iv)\.?(\s|$)", " ")
    flat = F.trim(F.regexp_replace(F.regexp_replace(bare, "-", " "), r"\s+", " "))
    head = F.regexp_extract(flat, r"^(\S*)", 1)
    short = F.try_element_at(F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv]), head)
    return F.when(short.isNotNull(), F.concat(short, F.substring(flat, F.length(head) + 1, F.length(flat)))).otherwise(flat)
