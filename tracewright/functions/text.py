"""Text expressions: masks, hashes, token counts, slugs, narrative scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-token masks, first match wins (fixed values).
MASKS = (
    (r"^\d+\.\d+\.\d+\.\d+$", "<IP>"),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "<UUID>"),
    (r"^\d+$", "<NUM>"),
    (r"^/[\w/.\-]+$", "<PATH>"),
)
#: Connecting phrases of a coherent narrative (fixed values).
CONNECTORS = ("therefore", "because", "as a result", "consequently", "this means", "next", "then", "finally")
#: Reactive operators of a call chain, and those that branch it (fixed values).
REACTIVE = (
    "flatMap", "map", "filter", "switchMap", "concatMap", "zipWith", "mergeWith", "then", "thenReturn", "onErrorResume", "onErrorReturn", "onErrorMap",
    "subscribe", "block", "toFuture", "doOnNext", "doOnError", "doOnComplete", "publishOn", "subscribeOn", "parallel",
)
BRANCHING = ("switchIfEmpty", "switchMap", "zipWith", "mergeWith", "onErrorResume", "retry", "retryWhen")
#: Operator names counted in raw source for migration features (fixed values).
COUNTED = ("flatMap", "switchMap", "concatMap", "zipWith", "retryWhen", "map", "filter", "doOnNext", "then", "transform", "block", "subscribe")
#: Words that the code analyzer drops (fixed values).
CODE_STOP_WORDS = ("import", "package", "public", "private", "protected", "class", "interface", "void", "return", "new", "this", "super")


def mask_token(token: Column) -> Column:
    return reduce(lambda rest, m: F.when(token.rlike(m[0]), F.lit(m[1])).otherwise(rest), reversed(MASKS), token)


def masked_tokens(message: Column) -> Column:
    """Masked tokens of a message; null for a blank one."""
    return F.when(F.trim(message) != "", F.transform(F.split(F.trim(message), r"\s+"), mask_token))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s{}();,.<>]+"), lambda x: F.trim(x) != "")).cast("long")


def truncated(text: Column, most: int, dots: bool = False) -> Column:
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")) if dots else cut)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def occurrences(text: Column, words: tuple[str, ...] = COUNTED) -> Column:
    """Non-overlapping occurrences of each word, added up."""
    each = [(F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words]
    return reduce(lambda a, b: a + b, each).cast("long")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def coherence(narrative: Column) -> Column:
    """Mean of a section score (5 headings give 1) and a connector score (4 phrases give 1)."""
    sections = F.least(F.lit(1.0), F.size(F.split(narrative, r"(?m)^#{1,3} ")) / 5.0)
    found = reduce(lambda a, b: a + b, [F.lower(narrative).contains(c).cast("int") for c in CONNECTORS])
    return (sections + F.least(F.lit(1.0), found / 4.0)) / 2.0


def judge_score(answer: Column) -> Column:
    """Score in a model's JSON answer, fences stripped; 0.5 if there is none."""
    body = F.trim(F.regexp_replace(F.regexp_replace(answer, r"(?s)```json\s*", ""), r"(?s)```\s*$", ""))
    return F.coalesce(F.get_json_object(body, "$.score").cast("double"), F.lit(0.5))


def database_name(url: Column) -> Column:
    """Database of a JDBC URL: what follows the last slash, without parameters; else what follows the
    host's colon."""
    after = F.regexp_extract(url, r"(?s)/([^/]+)\z", 1)
    named = F.when(F.instr(after, "?") > 1, F.substring_index(after, "?", 1)).otherwise(after)
    port = F.regexp_extract(url, r"(?s)\A(?:.*?://[^:]*|[^:]{2}[^:]*):(.*)\z", 1)
    return F.when(F.coalesce(named, F.lit("")) != "", named).when(F.coalesce(port, F.lit("")) != "", port).otherwise(F.lit("unknown"))


def calls(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(\w+)\s*\("), F.lit(1))


def reactive_complexity(names: Column) -> Column:
    """NONE, LINEAR, BRANCHING or COMPLEX by the operators among the called names."""
    of = lambda words: F.size(F.filter(names, lambda n: n.isin(*words)))
    reactive, branching = of(REACTIVE), of(BRANCHING)
    return F.when(reactive == 0, "NONE").when((branching >= 2) | (reactive >= 6), "COMPLEX").when(branching >= 1, "BRANCHING").otherwise("LINEAR")


def difficulty(complexity: Column) -> Column:
    """Rule for a migration's difficulty where no model is given (fixed values)."""
    return F.when(complexity == "NONE", "TRIVIAL").when(complexity == "LINEAR", "LOW").when(complexity == "BRANCHING", "MEDIUM").otherwise("HIGH")


#: In the order of their ordinals (fixed values).
COMPLEXITIES = ("NONE", "LINEAR", "BRANCHING", "COMPLEX")


def complexity_ordinal(complexity: Column) -> Column:
    return F.greatest(F.array_position(F.array(*map(F.lit, COMPLEXITIES)), F.upper(F.coalesce(complexity, F.lit("NONE")))) - 1, F.lit(0)).cast("int")


#: What parts terms: all but letters, their combining marks and digits of any script.
NOT_TERM = r"[^\p{L}\p{M}\p{N}]+"


def analyzed(text: Column, code: bool = False) -> Column:
    """Lower-cased terms of a text; code: also cut at camel case, without the stop words."""
    if code:
        text = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    terms = F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t != "")
    return F.filter(terms, lambda t: ~t.isin(*CODE_STOP_WORDS)) if code else terms


def log_passage(service: Column, severity: Column, template: Column, exception: Column, message: Column, logger: Column) -> Column:
    """What is embedded of a log event."""
    failed = F.when(exception.isNotNull(), F.concat(F.lit(" | exception: "), exception, F.coalesce(F.concat(F.lit(" - "), truncated(message, 200, dots=True)), F.lit(""))))
    return F.concat(F.lit("passage: ["), service, F.lit("] "), severity, F.lit(": "), template, F.coalesce(failed, F.lit("")), F.coalesce(F.concat(F.lit(" | logger: "), logger), F.lit("")))


def template_passage(service: Column, template: Column, count: Column) -> Column:
    return F.concat(F.lit("passage: ["), service, F.lit("] Log template: "), template, F.lit(" (frequency: "), count.cast("string"), F.lit(")"))


def query_text(query: Column) -> Column:
    return F.concat(F.lit("query: "), query)


def code_passage(kind: Column, fqn: Column, method: Column, annotations: Column, content: Column) -> Column:
    named = F.concat(F.lit("// "), kind, F.lit(": "), fqn, F.when(F.coalesce(method, F.lit("")) != "", F.concat(F.lit("."), method)).otherwise(""), F.lit("\n"))
    marks = F.when(F.size(F.coalesce(annotations, F.array().cast("array<string>"))) > 0, F.concat(F.lit("// Annotations: "), F.array_join(annotations, ", "), F.lit("\n"))).otherwise("")
    return F.concat(named, marks, F.coalesce(content, F.lit("")))
