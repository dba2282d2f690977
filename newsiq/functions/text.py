"""Text and URL expressions: relevance gate, normalisation, hints, cleaning.

Everything here is a column expression evaluated in the JVM.  Two regex
dialects occur in the behaviour being matched: a Unicode-aware word boundary
(the relevance gate) and an ASCII one (the content score).  Both are written
with explicit look-arounds, so results do not depend on the Java version.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relevance words matched as whole words, any case.
AI_WORDS = (
    "ai|agi|asi|llm|gpt|claude|gemini|openai|anthropic|deepmind|mistral|llama|groq|cohere|sora|midjourney|"
    "runway|nvidia|hugging|transformers|neural|multimodal|generative|agents|agent|embedding|rag|inference|"
    "benchmark|gpu|h100|a100|compute"
)
# Relevance phrases matched anywhere, any case.
AI_PHRASES = r"fine[- ]tun|training run|foundation model|reasoning model|o1[-\s]|o3[-\s]|o4[-\s]"
# every phrase holds one of these
AI_PHRASE_PARTS = ("fine", "training run", "foundation model", "reasoning model", "o1", "o3", "o4")
# Relevance substrings, exact case.
AI_ZH = (
    "人工智能", "大模型", "语言模型", "神经网络", "深度学习", "机器学习",
    "生成式", "多模态", "算力", "芯片", "英伟达",
    "智谱", "文心", "通义", "混元", "月之暗面", "零一万物", "阶跃星辰",
    "DeepSeek", "百川", "商汤", "科大讯飞", "华为盘古",
)
# Query parameters dropped from canonical URLs (besides utm_*).
TRACKING_PARAMS = ("fbclid", "gclid", "mc_cid", "mc_eid", "mkt_tok", "ref", "ref_src", "spm")
# Boilerplate phrases.
BOILERPLATE = (
    "subscribe to (?:our|the) newsletter",
    "sign up for (?:our|the) newsletter",
    "share this (?:article|post)",
    "read more",
    "cookie policy",
)
BOILERPLATE_WORDS = ("newsletter", "share this ", "read more", "cookie policy")
# Patterns that mark technical content.
TECHNICAL = (
    "methods?", "benchmarks?", "models?", "release notes?", "tables?", "sections?",
    "evaluations?", "architecture", "safety",
)
# Content-type hints, first match wins.
CONTENT_TYPES = (
    ("safety", "safety|preparedness|risk|alignment|policy"),
    ("engineering", "engineering|infrastructure|systems|latency|scaling"),
    ("research", "research|paper|method|benchmark|evaluation|circuits|model card"),
    ("technical_report", "technical report|system card|report"),
    ("product", "product|api|release notes|pricing|launch|app"),
    ("news", "news|announcement|announces|introducing"),
)

HAN = r"㐀-鿿"
ASCII_L, ASCII_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
WORD_L, WORD_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_c(x), r"[\s\u00a0\ufeff\u2028\u2029]+", " "))


def _by_first_letter(words: str) -> str:
    """Alternation grouped by first letter, which a backtracking matcher leaves sooner."""
    groups: dict[str, list[str]] = {}
    for w in words.split("|"):
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{k}(?:{'|'.join(v)})" for k, v in groups.items())


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(x, F.lit(w)) for w in words])


def is_ai_relevant(x: Column | str) -> Column:
    """Relevance gate: whole words, then phrases, then Han substrings.  NULL text gives false.

    Plain searches come before the expressions that only few texts need.
    """
    x = _c(x)
    words = f"{WORD_L}(?:{_by_first_letter(AI_WORDS)}){WORD_R}"
    low = F.lower(x)
    hit = low.rlike(words) | contains_any(x, AI_ZH) | (contains_any(low, AI_PHRASE_PARTS) & low.rlike(AI_PHRASES))
    return F.coalesce(hit, F.lit(False))


def canonical_url(x: Column | str) -> Column:
    """Drop fragment, tracking parameters, index page and trailing slashes.

    Scheme and host are lower-cased and default ports removed, as URL parsers
    do.  Text that is not an absolute URL comes back trimmed.
    """
    raw = F.trim(_c(x))
    part = lambda p, g: F.regexp_extract(raw, p, g)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?"
    scheme = F.lower(part(pattern, 1))
    host = F.lower(part(pattern, 2))
    host = (
        F.when(scheme == "https", F.regexp_replace(host, ":443$", ""))
        .when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .otherwise(host)
    )
    path = F.regexp_replace(F.regexp_replace(part(pattern, 3), r"(?i)/index\.html?$", ""), "/+$", "")
    query = F.regexp_replace(part(pattern, 4), r"^\?", "")
    dropped = rf"(?i)^(?:utm_[^=]*|{'|'.join(TRACKING_PARAMS)})(?:=|$)"
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(dropped)), "&")
    # the path of a parsed URL is never empty
    path = F.when(path == "", F.lit("/")).otherwise(path)
    url = F.concat(scheme, F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"), url).otherwise(raw)


def let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _ranges(codes: list[int], harmless) -> str:
    """Regex class of ``codes``; gaps of ``harmless`` code points are bridged."""
    out, start, prev = [], codes[0], codes[0]
    for code in codes[1:]:
        if not all(harmless(c) for c in range(prev + 1, code)):
            out.append((start, prev))
            start = code
        prev = code
    out.append((start, prev))
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out) + "]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str, str]:
    """Compatibility folding of the basic plane, generated from ``unicodedata``.

    Returns (class of letters followed by marks, characters to map, their base
    letters, class of characters that expand to several kept letters, those
    expansions as ``char:text`` pairs).
    """
    marked, source, target, expanded = [], [], [], {}
    for code in range(0x80, 0x10000):
        if 0x3400 <= code <= 0x9FFF or 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        nfkd = unicodedata.normalize("NFKD", ch)
        kept = [c for c in nfkd if (c.isascii() and c.isalnum()) or "一" <= c <= "鿿"]
        if nfkd == ch or not kept:
            continue
        if len(kept) == 1:
            source.append(ch)
            target.append(kept[0])
            if len(nfkd) > 1:
                marked.append(code)
        else:
            expanded[ch] = "".join(c if c in kept else " " for c in nfkd)
    # a character that is dropped anyway may be followed by one more separator
    mapped = set(source) | set(expanded)
    harmless = lambda c: c > 0x7F and not (0x3400 <= c <= 0x9FFF) and chr(c) not in mapped
    pairs = ";".join(f"{c}={b}" for c, b in expanded.items())
    codes = [ord(c) for c in expanded]
    return _ranges(marked, harmless), "".join(source), "".join(target), _ranges(codes, harmless), pairs


def fold_compat(x: Column | str) -> Column:
    """Compatibility decomposition as far as the kept alphabet is concerned.

    Combining marks become separators, like every other character outside
    ``[a-z0-9]`` and Han, so a marked letter is its base letter and a space.
    Plain ASCII text skips the work.
    """
    marked, source, target, multi, pairs = _fold_tables()
    table = F.str_to_map(F.lit(pairs), F.lit(";"), F.lit("="))
    spell = lambda v: F.array_join(
        F.transform(F.split(v, ""), lambda c: F.coalesce(F.element_at(table, c), c)), ""
    )
    one = lambda v: F.translate(F.regexp_replace(v, f"({marked})", "$1 "), source, target)
    return let(
        _c(x),
        lambda v: F.when(F.octet_length(v) == F.length(v), v).when(v.rlike(multi), one(spell(v))).otherwise(one(v)),
    )


def drop_boilerplate(x: Column | str) -> Column:
    """Replace the boilerplate phrases of a lower-cased text by spaces."""
    def chain(v: Column) -> Column:
        out = v
        for phrase in BOILERPLATE:
            out = F.regexp_replace(out, f"{ASCII_L}{phrase}{ASCII_R}", " ")
        # the plain search decides for most texts that there is nothing to replace
        maybe = contains_any(v, BOILERPLATE_WORDS)
        return F.when(maybe, out).otherwise(v)

    return let(_c(x), chain)


def normalize_text(x: Column | str) -> Column:
    """Lower-case, drop boilerplate and apostrophes, keep ``[a-z0-9]`` and Han, squeeze."""
    text = drop_boilerplate(F.lower(F.coalesce(_c(x), F.lit(""))))
    text = F.regexp_replace(fold_compat(text), "['’]", "")
    return F.trim(F.regexp_replace(text, r"(?i)[^a-z0-9一-鿿]+", " "))


def usable_content(title: Column | str, body: Column | str, published: Column | str) -> Column:
    """Struct (score, usable_chars, technical_hits, boilerplate_hits) of one article."""
    text = squeeze(F.coalesce(_c(body), F.lit("")))
    bonus = F.when(F.trim(F.coalesce(_c(title), F.lit(""))) != "", 250).otherwise(0) + F.when(
        _c(published).isNotNull(), 150
    ).otherwise(0)

    def measure(v: Column) -> Column:
        return let(F.lower(v), lambda low: counts(v, low))

    def counts(v: Column, low: Column) -> Column:
        some = contains_any(low, BOILERPLATE_WORDS)
        hits = sum((F.regexp_count(v, F.lit(f"(?i){ASCII_L}{p}{ASCII_R}")) for p in BOILERPLATE), F.lit(0))
        # a plain search for the word goes before the pattern
        tech = sum(((F.contains(low, F.lit(p.removesuffix("s?"))) & v.rlike(f"(?i){ASCII_L}(?:{p}){ASCII_R}")).cast("int") for p in TECHNICAL), F.lit(0))
        return F.struct(
            F.length(v).alias("chars"), tech.alias("tech"), F.when(some, hits).otherwise(0).alias("boiler"),
            F.length(normalize_text(v)).alias("kept"),
        )

    def score(m: Column) -> Column:
        ratio = F.lit(1.0) - m["kept"] / F.greatest(m["chars"], F.lit(1))
        penalty = F.when(m["kept"] > 0, F.greatest(F.lit(0), F.floor(ratio * 100 + 0.5))).otherwise(F.lit(0))
        total = m["chars"] + bonus + m["tech"] * 80 - m["boiler"] * 120 - penalty
        return F.struct(
            total.cast("long").alias("score"), m["chars"].cast("long").alias("usable_chars"),
            m["tech"].cast("long").alias("technical_hits"), m["boiler"].cast("long").alias("boilerplate_hits"),
        )

    return let(let(text, measure), score)


def content_type_hint(url: Column | str, title: Column | str, body: Column | str) -> Column:
    """First matching content type of the normalised url, title and body."""
    text = normalize_text(F.concat_ws(" ", *[F.coalesce(_c(c), F.lit("")) for c in (url, title, body)]))

    def first(v: Column) -> Column:
        out = F
        for label, words in CONTENT_TYPES:
            out = out.when(v.rlike(f"{ASCII_L}(?:{words}){ASCII_R}"), label)
        return out.otherwise("unknown")

    return let(text, first)


def infer_org(name: Column | str, url: Column | str) -> Column:
    """Organisation named in a source's name or URL."""
    text = F.lower(F.concat_ws(" ", _c(name), _c(url)))
    return (
        F.when(text.contains("anthropic"), "anthropic")
        .when(text.contains("deepmind"), "google_deepmind")
        .when(text.contains("openai"), "openai")
        .otherwise("unknown")
    )


def decode_entities(x: Column | str, names: tuple[str, ...] = ("amp", "lt", "gt", "quot", "#39", "nbsp")) -> Column:
    """Decode a short list of HTML entities, ``&amp;`` first."""
    # Entity name to character.
    chars = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " "}
    out = _c(x)
    for name in names:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(chars[name]))
    return out


def strip_html(x: Column | str, numeric_entities: bool = True) -> Column:
    """Remove style and script blocks and tags, decode entities, squeeze."""
    out = F.regexp_replace(_c(x), r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", "")
    out = decode_entities(F.regexp_replace(out, "<[^>]+>", " "), ("amp", "lt", "gt", "nbsp"))
    if numeric_entities:
        out = F.regexp_replace(out, r"&#\d+;", "")
    return squeeze(out)


def is_walled(x: Column | str) -> Column:
    """Subscription wall in the first 300 characters, or a verification wall anywhere."""
    x = F.coalesce(_c(x), F.lit(""))
    lede = F.lower(F.substring(x, 1, 300))
    paywall = lede.contains("subscribe") & lede.contains("sign in")
    return paywall | has_verification_wall(x)


def has_verification_wall(x: Column | str) -> Column:
    return _c(x).rlike("环境异常|当前环境异常|完成验证后即可继续访问|去验证")


def bullets(x: Column | str) -> Column:
    """Bullet lines of a summary joined by `` | ``."""
    lines = F.filter(F.split(F.coalesce(_c(x), F.lit("")), "\n"), lambda s: s.rlike(r"^\s*[•-]"))
    return F.array_join(lines, " | ")


def in_window(published: Column | str, created: Column | str, start: Column, end: Column) -> Column:
    """Published inside ``[start, end)``, or unpublished and created inside it.

    Kept as an OR of plain comparisons so both branches push to the scan.
    """
    p, c = _c(published), _c(created)
    return ((p >= start) & (p < end)) | (p.isNull() & (c >= start) & (c < end))


def language(x: Column | str) -> Column:
    return F.when(_c(x).rlike(f"[{HAN}]"), "zh").otherwise("en")


def sanitize_for_embedding(x: Column | str, cap: int = 2500) -> Column:
    """Drop NULs, blank out control characters, squeeze and cut."""
    out = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\x00", "")
    out = F.regexp_replace(out, r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.substring(squeeze(out), 1, cap)


def trigrams(x: Column | str) -> Column:
    """Distinct trigrams of the words of a text, each word padded two left and one right."""
    words = F.filter(F.split(F.lower(_c(x)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) + 1),
                lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
            ),
        )
    )
    return F.array_distinct(grams)


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared over united trigrams; 0 when both texts have none."""
    return set_similarity(trigrams(a), trigrams(b))


def set_similarity(left: Column, right: Column) -> Column:
    """Jaccard of two arrays of distinct elements; 0 when both are empty."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def register(spark) -> None:
    """Make the relevance gate callable from ``spark.sql`` text."""
    words = f"(?iu){WORD_L}(?:{AI_WORDS}){WORD_R}".replace("\\", "\\\\")
    phrases = f"(?iu)(?:{AI_PHRASES})".replace("\\", "\\\\")
    zh = "|".join(AI_ZH)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION is_ai_relevant(content STRING) RETURNS BOOLEAN RETURN "
        f"coalesce(content RLIKE '{words}' OR content RLIKE '{phrases}' OR content RLIKE '{zh}', false)"
    )
