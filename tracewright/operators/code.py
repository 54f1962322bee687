"""Java sources: classes, methods, chunks, migration features.

The parser is a tokenizer with brace matching: packages, imports, classes, interfaces, records, enums,
fields, methods, annotations. It does not read expressions; calls are names before an
opening parenthesis. A nested type's name holds those around it. What names mean is settled in operators.names."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import text
from tracewright.session import ship

#: Annotations by kind, without packages (fixed values).
HTTP = ("Get", "Post", "Put", "Delete", "Patch", "Options", "Head", "HttpMethodMapping")
INJECTION = ("Inject", "Value", "Property", "Named", "Singleton", "Prototype", "RequestScope", "Context")
MESSAGING = ("KafkaListener", "KafkaClient", "Topic", "RabbitListener", "RabbitClient")
REACTIVE_TYPES = ("Mono", "Flux", "Publisher", "Single", "Observable", "Maybe")
CHUNK_TOKENS, SIGNATURE_CHARS = 512, 2000

METHOD = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("return_type", T.StringType()), T.StructField("annotations", T.ArrayType(T.StringType())), T.StructField("http_methods", T.ArrayType(T.StringType())),
    T.StructField("path", T.StringType()), T.StructField("body", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()),
])
FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("annotations", T.ArrayType(T.StringType())), T.StructField("injected", T.BooleanType())])
CLASS = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("package", T.StringType()), T.StructField("simple_name", T.StringType()), T.StructField("fqn", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("annotations", T.ArrayType(T.StringType())), T.StructField("interfaces", T.ArrayType(T.StringType())), T.StructField("imports", T.ArrayType(T.StringType())), T.StructField("fields", T.ArrayType(FIELD)),
    T.StructField("methods", T.ArrayType(METHOD)), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("source", T.StringType()),
])

HIDDEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)
TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)(?:<[^{]*?>)?\s*(?:\([^{]*?\))?\s*(?:extends\s+[\w.<>, ]+?)?\s*(?:implements\s+([\w.<>,\s]+?))?\s*\{")
ANNOTATION = re.compile(r"@([\w.]+)(\s*\((?:[^()]|\([^()]*\))*\))?")
MEMBER = re.compile(r"^(?:(?:public|protected|private|static|final|abstract|default|synchronized|native|transient|volatile)\s+)*(?:<[^>]+>\s+)?([\w.<>\[\],? ]+?)\s+(\w+)\s*\(([^{;]*)\)\s*(?:throws\s+[\w., ]+)?$", re.S)
VARIABLE = re.compile(r"^(?:(?:public|protected|private|static|final|transient|volatile)\s+)*([\w.<>\[\],? ]+?)\s+(\w+)\s*(?:=.*)?$", re.S)


def simple(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def closing(code: str, at: int) -> int:
    """Place of the brace that closes the one at `at`."""
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == "{") - (code[i] == "}")
        if not depth:
            return i
    return len(code) - 1


def annotations(head: str, original: str) -> tuple[list[str], str, dict[str, str]]:
    """(names, what follows them, argument of each)."""
    names, args = [], {}
    for m in ANNOTATION.finditer(head):
        if simple(m[1]) == "interface":
            continue
        names.append(simple(m[1]))
        got = re.search(r'"([^"]*)"', original[m.start() : m.end()])
        args[simple(m[1])] = got[1] if got else ""
    blank = ANNOTATION.sub(lambda m: " " * len(m[0]), head)
    return names, blank.strip(), args


def parse(path: str, source: str) -> list[dict]:
    """Top-level and nested types of one file."""
    blind = HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    line = lambda i: source.count("\n", 0, i) + 1
    package = (re.search(r"\bpackage\s+([\w.]+)\s*;", blind) or [None, ""])[1]
    imports = re.findall(r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;", blind)
    found, around = [], []
    for m in TYPE.finditer(blind):
        open_at = m.end() - 1
        end = closing(blind, open_at)
        around = [(until, n) for until, n in around if until > m.start()] + [(end, m[2])]
        full = ".".join(([package] if package else []) + [n for _, n in around])
        begin = max(blind.rfind(";", 0, m.start()), blind.rfind("}", 0, m.start()), blind.rfind("{", 0, m.start())) + 1
        names, _, _ = annotations(blind[begin : m.start()], source[begin : m.start()])
        fields, methods, at = [], [], open_at + 1
        i = at
        while i < end:
            if blind[i] == ";" or blind[i] == "{":
                head, raw = blind[at:i], source[at:i]
                body_end = closing(blind, i) if blind[i] == "{" else i
                marks, plain, args = annotations(head, raw)
                start = at + len(head) - len(head.lstrip())
                if (g := MEMBER.match(plain)) and g[1] not in ("new", "return", "class", "record", "enum", "interface") and "=" not in plain:
                    verbs = [a.upper() for a in marks if a in HTTP]
                    path_of = next((args[a] or "/" for a in marks if a in HTTP), "")
                    methods.append({"name": g[2], "return_type": g[1].strip(), "annotations": marks, "http_methods": verbs, "path": path_of, "body": source[start : body_end + 1], "line_start": line(start), "line_end": line(body_end)})
                elif blind[i] == ";" and (v := VARIABLE.match(plain)) and v[1] not in ("return", "package", "import"):
                    fields.append({"name": v[2], "type": v[1].strip(), "annotations": marks, "injected": any(a in INJECTION for a in marks)})
                i = at = body_end + 1
                continue
            i += 1
        interfaces = [x.strip() for x in re.split(r",(?![^<]*>)", m[3])] if m[3] else []
        found.append({
            "file_path": path, "package": package, "simple_name": m[2], "fqn": full, "kind": m[1], "annotations": names, "interfaces": interfaces, "imports": imports, "fields": fields,
            "methods": methods, "line_start": line(m.start()), "line_end": line(end), "source": source[begin : end + 1].strip(),
        })
    return found


def parsed(files: DataFrame) -> DataFrame:
    """files(path, value: whole source) -> a row for each type."""
    ship(files.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [json.dumps(c) for p, v in zip(batch["path"], batch["value"], strict=True) for c in parse(p, v or "")]
            yield pd.DataFrame({"c": rows}, dtype=object)

    return files.select("path", "value").mapInPandas(work, "c string").select(F.from_json("c", CLASS).alias("c")).select("c.*")


def stripped(marks: Column) -> Column:
    return F.transform(marks, lambda a: F.substring_index(a, ".", -1))


def is_endpoint(marks: Column) -> Column:
    return F.exists(stripped(marks), lambda a: a.isin(*HTTP))


def is_injection(marks: Column) -> Column:
    return F.exists(stripped(marks), lambda a: a.isin(*INJECTION))


def is_handler(marks: Column) -> Column:
    return F.exists(stripped(marks), lambda a: a.isin(*MESSAGING))


def complexities(bodies: DataFrame) -> DataFrame:
    """bodies(..., body) + reactive_complexity, difficulty by rule."""
    level = text.reactive_complexity(text.calls(F.col("body")))
    return bodies.withColumn("reactive_complexity", level).withColumn("difficulty", text.difficulty(F.col("reactive_complexity")))


def split_lines(body: str, most: int, overlap: int = 0) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of runs of lines of at most `most` tokens; a longer line stands
    alone; overlap: lines repeated from the run before."""
    size = lambda s: sum(1 for t in re.split(r"[\s{}();,.<>]+", s) if t.strip())
    lines, out, at, held = body.split("\n"), [], 0, 0
    for i, one in enumerate(lines):
        n = size(one)
        if i > at and held + n > most:
            out.append(("\n".join(lines[at:i]), at + 1, i))
            at = max(at + 1, i - overlap)
            held = sum(size(x) for x in lines[at:i])
        held += n
    return [*out, ("\n".join(lines[at:]), at + 1, len(lines))]


def split_chunks(rows: DataFrame, most: int = CHUNK_TOKENS, overlap: int = 0) -> DataFrame:
    """rows(key, text) -> key, part, content, line_start, line_end, tokens."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, p, *c) for k, t in zip(batch["key"], batch["text"], strict=True) for p, c in enumerate(split_lines(t or "", most, overlap), 1)]
            yield pd.DataFrame(out, columns=["key", "part", "content", "line_start", "line_end"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.select("key", "text").mapInPandas(work, f"key {kind}, part int, content string, line_start int, line_end int")
    return out.withColumn("tokens", text.token_estimate(F.col("content")))


def chunks(classes: DataFrame) -> DataFrame:
    """A signature chunk of each class and its methods' chunks, with hashes and complexity."""
    sig = F.concat(F.lit("class "), F.col("fqn"), F.lit("\n"), F.array_join(F.transform("fields", lambda f: F.concat(f["type"], F.lit(" "), f["name"])), "\n"), F.lit("\n"), F.array_join(F.transform("methods", lambda m: F.concat(m["return_type"], F.lit(" "), m["name"], F.lit("()"))), "\n"))
    head = classes.select("file_path", "fqn", F.lit("").alias("method_name"), F.lit("CLASS_SIGNATURE").alias("chunk_type"), "annotations", F.substring(sig, 1, SIGNATURE_CHARS).alias("content"), "line_start", "line_end")
    methods = classes.select("file_path", "fqn", F.explode("methods").alias("m"))
    keyed = methods.select(F.to_json(F.struct("file_path", "fqn", "m.name", "m.line_start", "m.annotations")).alias("key"), F.col("m.body").alias("text"))
    spec = "file_path string, fqn string, name string, line_start int, annotations array<string>"
    parts = split_chunks(keyed).withColumn("k", F.from_json("key", spec))
    body = parts.select("k.file_path", "k.fqn", F.col("k.name").alias("method_name"), F.lit("METHOD").alias("chunk_type"), "k.annotations", "content", (F.col("k.line_start") + F.col("line_start") - 1).alias("line_start"), (F.col("k.line_start") + F.col("line_end") - 1).alias("line_end"))
    out = head.unionByName(body)
    return out.withColumns({"content_hash": text.content_hash(F.col("content")), "reactive_complexity": text.reactive_complexity(text.calls(F.col("content")))})


def migration_features(classes: DataFrame, embedding: Column, width: int = 64) -> DataFrame:
    """(fqn, features): the source's embedding, then ten measured features and zeros up to `width`."""
    m = F.col("methods")
    has = lambda f: F.exists(m, f).cast("float")
    level = lambda x: text.complexity_ordinal(text.reactive_complexity(text.calls(x["body"])))
    made = [
        text.occurrences(F.col("source")), F.size("annotations") + F.aggregate(m, F.lit(0), lambda a, x: a + F.size(x["annotations"])), F.size(F.filter("fields", lambda f: f["injected"])), F.size(m),
        has(lambda x: text.contains_any(x["return_type"], REACTIVE_TYPES)), F.size(F.filter(m, lambda x: F.size(x["http_methods"]) > 0)), has(lambda x: F.exists(x["annotations"], lambda a: a.contains("Kafka"))),
        F.size("interfaces"), F.greatest(F.lit(0), F.col("line_end") - F.col("line_start")), F.coalesce(F.array_max(F.transform(m, level)), F.lit(0)),
    ]
    return classes.select("fqn", F.concat(embedding, F.array(*(x.cast("float") for x in made)), F.array_repeat(F.lit(0.0).cast("float"), width - len(made))).alias("features"))


def class_difficulty(classes: DataFrame) -> DataFrame:
    """(fqn, complexity, difficulty, confidence) by the rule on the class's most complex method."""
    levels = F.transform("methods", lambda x: text.complexity_ordinal(text.reactive_complexity(text.calls(x["body"]))))
    most = F.element_at(F.array(*map(F.lit, text.COMPLEXITIES)), F.coalesce(F.array_max(levels), F.lit(0)) + 1)
    return classes.select("fqn", most.alias("complexity"), text.difficulty(most).alias("difficulty"), F.lit(0.5).alias("confidence"))


def difficulty_model(training: DataFrame, iterations: int = 20):
    """One-against-rest gradient-boosted trees over (features, label) arrays."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.functions import array_to_vector

    rows = training.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double"))
    return OneVsRest(classifier=GBTClassifier(maxIter=iterations, seed=1)).fit(rows)


