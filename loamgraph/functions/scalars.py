"""Scalar functions of the knowledge model as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a kind of question, in order of precedence.
HISTORY = "谁改|谁修改|提交|commit|git log|最近修改|变更历史|作者|什么时候改"
IMPACT = "影响|波及|下游|impact|dependents|被谁使用|影响链"
RELATION = "调用|引用|继承|实现|calls|imports|extends|implements|接口调用|api|endpoint|路由"
RELATION_STRONG = "/|api|调用|引用|继承"
LOOKUP = "在哪里|在哪个文件|where is|定义位置|类定义|符号"
BUSINESS = "业务|规则|为什么|流程|设计原则|分配规则|销售|转换|business|workflow"
CODE = "实现|代码|代码块|函数体|逻辑|how is|code|implementation"
SEMANTIC = "架构|设计|怎么处理|原理|规范|overview|architecture"
# Channel weights by kind of question.
WEIGHTS = {
    "ENTITY_LOOKUP": {"ENTITY": 0.65, "KEYWORD": 0.25, "VECTOR": 0.10},
    "CODE_LOOKUP": {"KEYWORD": 0.45, "VECTOR": 0.35, "ENTITY": 0.20},
    "RELATION_QUERY": {"GRAPH": 0.60, "ENTITY": 0.20, "KEYWORD": 0.20},
    "BUSINESS_QUERY": {"VECTOR": 0.45, "KEYWORD": 0.35, "GRAPH": 0.20},
    "HISTORY_QUERY": {"TEMPORAL": 0.70, "KEYWORD": 0.30},
    "IMPACT_QUERY": {"GRAPH": 0.65, "ENTITY": 0.20, "KEYWORD": 0.15},
    "SEMANTIC_QUERY": {"VECTOR": 0.50, "KEYWORD": 0.30, "GRAPH": 0.20},
    "UNKNOWN": {"KEYWORD": 0.40, "ENTITY": 0.30, "VECTOR": 0.30},
}
# Languages by file extension, and words in a name or path that place it in a layer.
EXTENSIONS = {"java": "java", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "vue": "vue", "py": "python", "json": "json", "sql": "sql", "md": "markdown", "yaml": "yaml", "yml": "yaml", "xml": "xml", "css": "css", "sh": "shell"}
LAYERS = {
    "page": "view|page|layout",
    "component": "component|panel|modal|drawer|table|button",
    "api": "api|controller|endpoint|client|request",
    "service": "service|manager|handler|helper|util",
    "rule": "rule|validator|policy|business",
}
_DELIMITERS = "[\\s,.;:!?()\\[\\]{}<>\"'`/\\\\|=+*&^%$#@~，。；：！？（）【】《》、]+"


def lower_terms(text: Column) -> Column:
    """The runs of letters and digits a to z of a text, in lower case, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def index_terms(text: Column) -> Column:
    """Terms of the lexical index.

    Each part between delimiters gives its CJK characters and pairs of
    neighbouring ones, the humps of its identifiers (two characters or more),
    and itself in lower case if it has several humps or no Latin run.
    """

    def of(part: Column) -> Column:
        cjk = F.regexp_extract_all(part, F.lit("[一-鿿]"), F.lit(0))
        pairs = F.transform(F.slice(cjk, F.lit(2), F.greatest(F.size(cjk) - 1, F.lit(0))), lambda c, i: F.concat(cjk[i], c))
        humps = F.regexp_extract_all(part, F.lit(r"[A-Z]?[a-z0-9]+|[A-Z]+(?=[A-Z][a-z]|\b)"), F.lit(0))
        kept = F.filter(F.transform(humps, F.lower), lambda h: F.length(h) >= 2)
        whole = F.when((F.size(humps) > 1) | (F.size(humps) == 0), F.array(F.lower(part))).otherwise(F.array().cast("array<string>"))
        return F.concat(cjk, pairs, kept, whole)

    parts = F.filter(F.split(text, _DELIMITERS), lambda p: p != "")
    return F.flatten(F.transform(parts, of))


def intent(q: Column) -> Column:
    """The kind of a question; the first family whose words occur decides."""
    t = F.lower(q)
    single = F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda w: w != "")) == 1
    return (
        F.when(t.rlike(HISTORY) | t.rlike(r"\bauthor\b"), "HISTORY_QUERY")
        .when(t.rlike(IMPACT), "IMPACT_QUERY")
        .when(t.rlike(RELATION) & t.rlike(RELATION_STRONG), "RELATION_QUERY")
        .when(t.rlike(LOOKUP) | single & (F.trim(q).rlike("^[A-Z][a-zA-Z0-9]+$") | q.contains(".")), "ENTITY_LOOKUP")
        .when(t.rlike(BUSINESS), "BUSINESS_QUERY")
        .when(t.rlike(CODE), "CODE_LOOKUP")
        .when(t.rlike(SEMANTIC), "SEMANTIC_QUERY")
        .otherwise("UNKNOWN")
    )


def name_tokens(q: Column) -> Column:
    """Identifiers of three characters or more that have an upper-case letter."""
    return F.filter(F.regexp_extract_all(q, F.lit(r"\b[A-Za-z][A-Za-z0-9_]{2,}\b"), F.lit(0)), lambda t: t.rlike("[A-Z]"))


def path_tokens(q: Column) -> Column:
    """File paths with an extension, and routes."""
    return F.regexp_extract_all(q, F.lit(r"[\w\-_./]+\.[a-zA-Z0-9]+|/[\w\-_/]+"), F.lit(0))


def route(path: Column) -> Column:
    """A route with one leading slash, no query, doubled or trailing slashes, parameters as {param}."""
    p = F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\", "/")
    p = F.regexp_replace(F.concat(F.lit("/"), F.substring_index(p, "?", 1)), "/+", "/")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.regexp_replace(p, r"/(?::[a-zA-Z0-9_]+|\{[a-zA-Z0-9_]+\})", "/{param}")


def language(path: Column) -> Column:
    """Language by extension, null if none is known."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def layers(text: Column) -> Column:
    """Layers whose words occur anywhere in a path or name."""
    t = F.lower(text)
    return F.array_compact(F.array(*[F.when(t.rlike(words), F.lit(name)) for name, words in LAYERS.items()]))


def uri(repo: Column, path: Column, symbol: Column | None = None) -> Column:
    """repo://repository/path#symbol."""
    base = F.concat(F.lit("repo://"), repo, F.lit("/"), path)
    return base if symbol is None else F.when(symbol.isNull(), base).otherwise(F.concat(base, F.lit("#"), symbol))


def edge_key(source: Column, predicate: Column, target: Column) -> Column:
    return F.concat(F.lit("edge://"), source, F.lit("->"), predicate, F.lit("->"), target)


def symbol_key(project: Column, path: Column, kind: Column, qualified: Column, signature: Column) -> Column:
    return F.concat_ws(":", F.lit("SYMBOL"), project, path, kind, qualified, discriminator(signature))


def discriminator(signature: Column) -> Column:
    """First sixteen digits of the signature's SHA-256."""
    return F.substring(F.sha2(F.coalesce(signature, F.lit("")), 256), 1, 16)


def clipped(value: Column, most: int = 255) -> Column:
    """A value of at most ``most`` characters, unique by a hash where it was cut."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 17), F.lit("_"), F.substring(F.sha2(value, 256), 1, 16))).otherwise(value)


def pascal(name: Column) -> Column:
    """kebab or snake case as PascalCase."""
    return F.array_join(F.transform(F.filter(F.split(name, "[-_]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substring(w, 2, 10_000))), "")


def redact(url: Column) -> Column:
    """A URL without its password."""
    return F.regexp_replace(url, "://([^:@/]+):[^@]+@", "://$1:***@")


def bare_code(code: Column) -> Column:
    """Code without comments and white space, to tell format changes from others."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", ""), r"\s+", "")


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 20, 1.0).when(z <= -20, 0.0).otherwise(1 / (1 + F.exp(-z)))


def tempered(p: Column, temperature: Column | float) -> Column:
    """Confidence scaled by a temperature, to four decimals."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    return F.round(sigmoid(logit(p) / t), 4)


def dot(u: Column, v: Column) -> Column:
    """Dot product over the shorter length."""
    n = F.least(F.size(u), F.size(v))
    return F.aggregate(F.zip_with(F.slice(u, F.lit(1), n), F.slice(v, F.lit(1), n), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; as it is if it is almost null."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n < 1e-9, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def hash_bucket(token: Column, dimensions: int = 128) -> tuple[Column, Column]:
    """Bucket and sign of a token by its MD5 (dimensions: a power of two up to 256)."""
    h = F.md5(token)
    bucket = F.conv(F.substring(h, -2, 2), 16, 10).cast("int").bitwiseAND(dimensions - 1)
    sign = F.when(F.conv(F.substring(h, -3, 1), 16, 10).cast("int") % 2 == 0, -1).otherwise(1)
    return bucket, sign


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
