"""Rules for columns: validation, translations, attachments, timestamps and search helpers, as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the validation rules.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"

RULES = ("required", "email", "url", "min_length", "max_length", "length", "min", "max", "range", "regex", "alpha", "alphanumeric", "numeric", "uuid", "in", "not_in")


def valid(column: Column, rule: str, *args) -> Column:
    """Whether a value passes a rule. Only ``required`` looks at NULL: every other rule passes it."""
    text = column.cast("string")
    checks = {
        "required": lambda: column.isNotNull() & (F.length(F.trim(text)) > 0),
        "email": lambda: text.rlike(EMAIL),
        "url": lambda: text.rlike("^https?://") & F.try_parse_url(text, F.lit("HOST")).isNotNull(),
        "min_length": lambda: F.char_length(text) >= args[0],
        "max_length": lambda: F.char_length(text) <= args[0],
        "length": lambda: F.char_length(text).between(args[0], args[-1]),
        "min": lambda: column >= args[0],
        "max": lambda: column <= args[0],
        "range": lambda: column.between(args[0], args[1]),
        "regex": lambda: text.rlike(args[0]),
        "alpha": lambda: text.rlike(r"^\p{IsAlphabetic}*$"),
        "alphanumeric": lambda: text.rlike(r"^[\p{IsAlphabetic}\p{N}]*$"),
        "numeric": lambda: text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(text.try_cast("double")) < float("inf")),
        "uuid": lambda: text.rlike(UUID),
        "in": lambda: column.isin(*args[0]),
        "not_in": lambda: ~column.isin(*args[0]),
    }
    if rule not in checks:
        raise ValueError(f"no rule {rule!r}; there are {', '.join(RULES)}")
    passed = checks[rule]()
    return F.coalesce(passed, F.lit(False)) if rule == "required" else column.isNull() | F.coalesce(passed, F.lit(False))


def violations(rules: dict[str, Sequence[tuple]]) -> Column:
    """Array of ``field: rule`` for every rule that a row breaks."""
    marks = [F.when(~valid(F.col(field), name, *args), F.lit(f"{field}: {name}")) for field, listed in rules.items() for name, *args in listed]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


#: What is said of a broken rule; {0} is the field, the rule's arguments follow.
MESSAGES = {
    "required": "The {0} field is required",
    "email": "The {0} must be a valid email address",
    "url": "The {0} must be a valid URL",
    "min_length": "The {0} must be at least {1} characters",
    "max_length": "The {0} must not exceed {1} characters",
    "length": "The {0} must be exactly {1} characters",
    "min": "The {0} must be at least {1}",
    "max": "The {0} must not exceed {1}",
    "range": "The {0} must be between {1} and {2}",
    "regex": "The {0} format is invalid (must match: {1})",
    "alpha": "The {0} must only contain letters",
    "alphanumeric": "The {0} must only contain letters and numbers",
    "numeric": "The {0} must be a number",
    "uuid": "The {0} must be a valid UUID",
    "in": "The {0} must be one of: {1}",
    "not_in": "The {0} must not be one of: {1}",
}


def message(field: str, rule: str, *args) -> str:
    return MESSAGES[rule].format(field, *[", ".join(map(str, a)) if isinstance(a, (list, tuple, set)) else a for a in args])


def errors(rules: dict[str, Sequence[tuple]]) -> Column:
    """Map of a row's broken fields to the messages of the rules that each breaks, in order; empty for a valid row."""
    entries = []
    for field, listed in rules.items():
        said = F.filter(F.array(*[F.when(~valid(F.col(field), name, *args), F.lit(message(field, name, *args))) for name, *args in listed]), lambda x: x.isNotNull())
        entries.append(F.struct(F.lit(field).alias("key"), said.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


@dataclass(frozen=True)
class Checks:
    """Rules by field, one after the other: Checks().field("mail").rule("required").rule("email").rule("max_length", 80)."""

    rules: tuple[tuple[str, tuple], ...] = ()
    at: str | None = None

    def field(self, name: str) -> Checks:
        return replace(self, at=name)

    def rule(self, name: str, *args) -> Checks:
        if self.at is None or name not in RULES:
            raise ValueError("a rule follows a field, and is one of " + ", ".join(RULES))
        return replace(self, rules=(*self.rules, (self.at, (name, *args))))

    def by_field(self) -> dict[str, list[tuple]]:
        found: dict[str, list[tuple]] = {}
        for field, rule in self.rules:
            found.setdefault(field, []).append(rule)
        return found

    def errors(self) -> Column:
        return errors(self.by_field())

    def passed(self) -> Column:
        return F.size(self.errors()) == 0


# translations: a document {field: {language: value}}


def translation(text: Column, field: str, language: str) -> Column:
    """A field in a language; NULL where it has none."""
    return F.get_json_object(text, f"$['{field}']['{language}']")


def translated(text: Column, field: str, language: str, fallback: str, default: Column | None = None) -> Column:
    """A field in a language, else in the fallback, else the default."""
    return F.coalesce(translation(text, field, language), translation(text, field, fallback), *([default] if default is not None else []))


def all_translations(text: Column, field: str) -> Column:
    """Map of language to value of a field; empty for none."""
    return F.coalesce(F.from_json(F.get_json_object(text, f"$['{field}']"), "map<string,string>"), F.create_map().cast("map<string,string>"))


def translations_in(text: Column, fields: Sequence[str], language: str) -> Column:
    """Map of field to value in a language, for the fields that have it."""
    entries = F.array(*[F.struct(F.lit(f).alias("key"), translation(text, f, language).alias("value")) for f in fields])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def has_translation(text: Column, field: str, language: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(text, f"$['{field}']")), language), F.lit(False))


def render_translations(rows: DataFrame, document: str, fields: Sequence[str], language: str, fallback: str) -> DataFrame:
    """rows with the fields' columns in a language (else in the fallback, else as they are)."""
    return rows.withColumns({f: translated(F.col(document), f, language, fallback, F.col(f)) for f in fields})


def languages(text: Column, field: str) -> Column:
    """Languages that a field has, sorted."""
    return F.array_sort(F.json_object_keys(F.get_json_object(text, f"$['{field}']")))


def files(text: Column, relation: str) -> Column:
    """Attachments of a relation of a document {relation: file or [file]}, as an array of JSON texts."""
    one = F.get_json_object(text, f"$['{relation}']")
    return F.when(one.startswith("["), F.transform(F.from_json(one, "array<variant>"), F.to_json)).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def first_file(text: Column, relation: str) -> Column:
    """The first attachment of a relation, as JSON text; NULL for none."""
    return F.try_element_at(files(text, relation), F.lit(1))


def count_files(text: Column, relation: str) -> Column:
    return F.size(files(text, relation))


# timestamps as whole numbers


def moment(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def moment_of_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def unix_seconds(moment: Column) -> Column:
    return F.unix_seconds(moment.cast("timestamp"))


def unix_millis(moment: Column) -> Column:
    return F.unix_millis(moment.cast("timestamp"))


def seconds_of_millis(millis: Column) -> Column:
    """Whole seconds, rounded down also before 1970."""
    return F.floor(millis.cast("decimal(20,0)") / 1000).cast("long")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def quoted(words: Sequence[str]) -> str:
    """A pattern of whole words for Java's regular expressions."""
    return r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(f"\\Q{w}\\E" for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}_])"


def highlight(text: Column, words: Sequence[str], start: str = "<b>", end: str = "</b>") -> Column:
    """Every whole-word match between the tags, whatever its case."""
    safe = lambda tag: tag.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, quoted(words), f"{safe(start)}$1{safe(end)}") if words else text


def snippet(text: Column, words: Sequence[str], around: int, start: str = "<b>", end: str = "</b>") -> Column:
    """``around`` words before and after the first match, with ... where text was cut; the first words if nothing matches."""
    parts = F.split(text, r"\s+")
    hit = F.coalesce(F.array_position(F.transform(parts, lambda w: w.rlike(quoted(words)) if words else F.lit(False)), True), F.lit(0)).cast("int")
    first = F.greatest(F.lit(1), hit - around)
    count = F.when(hit == 0, F.lit(2 * around + 1)).otherwise(hit + around - first + 1)
    cut = F.array_join(F.slice(parts, first, count), " ")
    return F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), highlight(cut, words, start, end), F.when(first + count - 1 < F.size(parts), F.lit("...")).otherwise(F.lit("")))
