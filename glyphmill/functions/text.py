"""Text and path expressions built from higher-order functions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning in a symbol search.
STOP_WORDS = tuple("""
the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can shall not no all each
every how what where when who which why i me my we our you your he she they show give tell been done made used using work works found also into then than just more some such
over only out its so up as if look need needs want happen happens affect affected break breaks failing implemented implement code file files function method class type fix bug called
""".split())
#: Words without meaning in a question.
QUERY_STOP_WORDS = tuple("""
the a an and or but is in on at to for of with by from as into how what why where when which does do did can could should would will this that these those
be been being have has had it its i we you me my about any all
""".split())
#: Words without meaning in the label of a topic.
TOPIC_STOP_WORDS = tuple("""
a an the this that these those my our your their its it they some any all no none each every and or but if so than then of to in on at by for with from into onto as via about
is are was were be been being do does did doing done have has had having will would can could should may might must shall how what why when where which who whom whose
explain show tell list find give get set make see look help need want use used uses using work works working worked
fix fixes fixed fixing add adds added adding remove removes removed removing modify modifies modified modifying update updates updated updating
please just also only very more most less least such like even here there now yet still code codebase repo project
""".split())
#: Terms of an intent, in the order in which intents are tried.
INTENT_WORDS = (
    ("debug", ("debug", "bug", "error", "fix", "crash", "panic", "nil pointer", "why does", "broken", "failing", "failure", "wrong", "issue", "not working", "unexpected")),
    ("trace", ("trace", "flow", "propagate", "upstream", "downstream", "call chain", "how does", "reach", "path from", "path to", "end to end", "e2e", "sequence")),
    ("refactor", ("refactor", "rename", "move", "impact", "what breaks", "who uses", "who calls", "callers of", "dependents", "breaking change", "deprecate")),
    ("explore", ("what is", "explain", "understand", "overview", "how does", "describe", "summarize", "architecture", "structure", "purpose of", "role of")),
)


def split_symbol(x: Column) -> Column:
    """Lower-case parts of a camel, Pascal, snake or dotted name."""
    camel = F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(camel, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def words_of(x: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= least)


def keywords(x: Column) -> Column:
    """Distinct alphanumeric runs of three or more, lower-cased, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]{3,}"), 0))


def without_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def light_stem(w: Column) -> Column:
    """Drops one of ings, ing, ers, ed, es and s from words of over six characters if four stay, then one l of a final ll."""
    cut = F.regexp_replace(w, "(ings|ing|ers|ed|es|s)$", "")
    stem = F.when((F.length(w) > 6) & (F.length(cut) >= 4), cut).otherwise(w)
    return F.when((stem != w) & F.endswith(stem, F.lit("ll")), F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)


def query_words(x: Column) -> Column:
    """Trimmed of punctuation, two characters or more, no stop words, stemmed, distinct."""
    raw = F.transform(F.split(F.lower(F.coalesce(x, F.lit(""))), "\\s+"), lambda w: F.regexp_replace(w, "^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.array_distinct(F.transform(F.filter(raw, lambda w: (F.length(w) >= 2) & ~w.isin(*QUERY_STOP_WORDS)), light_stem))


def stem_variants(w: Column) -> Column:
    """The word and what suffix rules make of it."""
    rules = (("ing$", ""), ("ing$", "e"), ("ed$", ""), ("ed$", "e"), ("ies$", "y"), ("es$", ""), ("s$", ""), ("er$", ""))
    made = [F.when(F.rlike(w, F.lit(p)) & (F.length(w) > 4), F.regexp_replace(w, p, r)) for p, r in rules]
    return F.array_distinct(F.filter(F.array(w, *made), lambda v: v.isNotNull() & (F.length(v) >= 3)))


def topic_label(x: Column) -> Column:
    """The first three distinct words that aren't numbers, hyphened, cut at a hyphen to at most 40 characters."""
    words = F.filter(without_stop_words(words_of(x, 3), TOPIC_STOP_WORDS), lambda w: ~F.rlike(w, F.lit("^[0-9]+$")))
    label = F.array_join(F.slice(F.array_distinct(words), 1, 3), "-")
    cut = F.substring(label, 1, 40)
    return F.when(F.length(label) <= 40, label).when(F.contains(cut, F.lit("-")), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)


def symbols_in(x: Column) -> Column:
    """Names that a query spells out: camel, snake, SCREAMING and dotted forms."""
    forms = ("\\b[a-z]+(?:[A-Z][a-z0-9]+)+\\b", "\\b[a-z0-9]+(?:_[a-z0-9]+)+\\b", "\\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\\b", "\\b[A-Za-z]+(?:\\.[A-Za-z]+)+\\b")
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f), 0) for f in forms]))


def is_distinctive(x: Column) -> Column:
    return F.rlike(x, F.lit("[_0-9]|.[A-Z]"))


def name_token(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def intent(x: Column) -> Column:
    low, out = F.lower(F.coalesce(x, F.lit(""))), None
    for name, words in INTENT_WORDS:
        hit = F.rlike(low, F.lit("|".join(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def normal_path(x: Column) -> Column:
    """Trimmed, without slashes at its ends or a `:line` behind it, lower-cased."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), ":.*$", ""), "^/+|/+$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def summary(x: Column) -> Column:
    """The first sentence if under 200 characters, else the first line if it is, else 150 characters."""
    t = F.trim(F.coalesce(x, F.lit("")))
    sentence, line = F.substring_index(t, ". ", 1), F.substring_index(t, "\n", 1)
    return F.when((sentence != t) & (F.length(sentence) < 200), F.concat(sentence, F.lit("."))).when(F.length(line) < 200, line).otherwise(F.substring(t, 1, 150))


def file_paths_in(x: Column) -> Column:
    """The first token with a slash and an extension, or null."""
    return F.try_element_at(F.filter(F.split(F.coalesce(x, F.lit("")), "\\s+"), lambda w: F.rlike(w, F.lit("/.*\\.[A-Za-z0-9]+$"))), F.lit(1))


def content_id(kind: Column, *parts: Column) -> Column:
    """Kind and 32 hex digits of the sha256 of the parts joined by colons."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32))


def safe_key(x: Column) -> Column:
    return F.translate(x, ": /\\", "____")


def doc_comment(x: Column) -> Column:
    """Comment text without its marks."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), "^\\s*/\\*+|\\*+/\\s*$", "")
    return F.trim(F.regexp_replace(t, "(?m)^\\s*(\\*|//+|#+)\\s?", ""))


def slice_lines(x: Column, start: int, n: int, most: int = 65536) -> Column:
    return F.substring(F.array_join(F.slice(F.split(F.coalesce(x, F.lit("")), "\n", -1), start, n), "\n"), 1, most)


def language_of(path: Column) -> Column:
    """By extension."""
    known = {"go": "go", "java": "java", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "rb": "ruby", "rs": "rust", "php": "php", "cs": "csharp", "vue": "vue", "html": "html"}
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), ext), F.lit("unknown"))
