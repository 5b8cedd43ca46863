"""Column expressions on text, JSON and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identity fields that must not reach a prediction.
FORBIDDEN_TOKENS = ["candidate_id", "candidate_index", "primitive_ordinal", "primitive_orbit_ordinal", "source_joint_id", "occurrence_id", "body_id", "step_sha256"]
SURFACE_TOKENS = [("plane", "plane"), ("cylinder", "cylinder"), ("cone", "cone"), ("sphere", "sphere"), ("torus", "torus"), ("spline", "spline"), ("bezier", "spline")]
FEATURE_SLOTS = 128
_HEX = "0123456789abcdef"


def names_identity(text: Column) -> Column:
    """Whether a text names an identity field, with blanks or dashes for underscores."""
    plain = F.translate(F.lower(text), "- ", "__")
    return F.exists(F.array(*map(F.lit, FORBIDDEN_TOKENS)), lambda t: F.contains(plain, t))


def unfenced(text: Column) -> Column:
    """A response without its code fence."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-z]*\s*", ""), r"\s*```\s*$", "")


def strict_object(text: Column) -> Column:
    """The text as a variant, null unless it is one JSON object without repeated keys or constants that JSON lacks."""
    value = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def sentences(text: Column) -> Column:
    """Trimmed sentences that hold something."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _digit(text: Column, place: int) -> Column:
    return F.instr(F.lit(_HEX), F.substring(text, place, 1)) - 1


def feature_tokens(text: Column) -> Column:
    """Words and character triples of a text, in lower-case letters and digits."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    line = F.array_join(words, "_")
    # overlapping triples in one pass: a body that names the line would work it out again for each of them
    triples = F.regexp_extract_all(line, F.lit("(?=(...))"), F.lit(1))
    return F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.transform(triples, lambda t: F.concat(F.lit("c3:"), t)))


def feature_slot(token: Column) -> tuple[Column, Column]:
    """(slot, sign) of a token, from its SHA-256: the first four bytes modulo the slots, and the low bit of the fifth."""
    digest = F.sha2(token, 256)
    return (_digit(digest, 7) * 16 + _digit(digest, 8)) % FEATURE_SLOTS, F.when(_digit(digest, 10) % 2 == 1, 1.0).otherwise(-1.0)


def surface_bucket(name: Column) -> Column:
    found = F.lit("other")
    for token, bucket in reversed(SURFACE_TOKENS):
        found = F.when(F.contains(F.lower(F.trim(name)), F.lit(token)), bucket).otherwise(found)
    return found


def safe_name(name: Column, default: str = "assembly") -> Column:
    """A name of letters, digits, _ . and - alone, that begins and ends with a letter or digit."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), F.lit("_.-")), F.lit("")), F.lit(default))


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def case_token(*parts: Column) -> Column:
    """SHA-256 of the parts with a NUL between them."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def row_hash(*fields: Column) -> Column:
    """SHA-256 of a row's fields in a canonical text; null and empty differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("~")) for f in fields]), 256)


def scope_fault(text: Column, flags: list[str], forbidden: list[str]) -> Column:
    """Why a public JSON payload is not public: not_json, flag (one of the flags at its top is not false), field (a forbidden key at any depth); null if it is."""
    value = F.try_parse_json(text)
    shape = F.schema_of_variant(value)
    fault = F.when(value.isNull(), "not_json")
    for name in flags:
        fault = fault.when(~F.coalesce(F.try_variant_get(value, f"$.{name}", "boolean") == F.lit(False), F.lit(False)), "flag")
    # the shape of a value names every key that it holds, those of objects in arrays too
    names = "|".join(forbidden)
    return fault.when(shape.rlike(f"[<, ]`?({names})`?: "), "field")
