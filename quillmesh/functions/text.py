"""Scalar text functions over columns: tokens, normal forms, links, markup. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Korean particles stripped from the ends of tokens, compound ones first.
COMPOUND_PARTICLES = ("에서", "으로", "까지", "부터", "에게", "한테", "처럼", "만큼", "보다", "이나", "이랑")
SINGLE_PARTICLES = "은는이가을를의에와과로"

#: Text, section and alias of a link [[target#section|alias]].
WIKILINK = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of two code points or more, in order, repeats included."""
    words = F.split(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 1)


def similarity_tokens(text: Column | str) -> Column:
    """Tokens for fuzzy comparison: split at blanks and punctuation, Korean particles stripped from the end."""
    words = F.filter(F.split(F.lower(col(text)), r"[\s\-_.,;:!?'\"()\[\]{}]+"), lambda w: F.length(w) > 0)
    compound = r"^(.+)(?:" + "|".join(COMPOUND_PARTICLES) + r")$"
    single = rf"^(.+)[{SINGLE_PARTICLES}]$"

    def strip(w: Column) -> Column:
        return F.when((F.length(w) > 2) & F.rlike(w, F.lit(compound)), F.regexp_replace(w, compound, "$1")).when((F.length(w) > 1) & F.rlike(w, F.lit(single)), F.regexp_replace(w, single, "$1")).otherwise(w)

    return F.transform(words, strip)


def keywords(text: Column | str, stop_words: list[str]) -> Column:
    """Lower-case words of two code points or more without stop words; repeats stay."""
    words = F.split(F.lower(col(text)), r"[\s,.?!;:'\"()\[\]{}]+")
    stops = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))


def normalize_title(text: Column | str) -> Column:
    """Lower case, trimmed, no .md, dashes and underscores as blanks, blanks collapsed."""
    t = F.regexp_replace(F.trim(F.lower(col(text))), r"\.md$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[-_]", " "), r"(?U)\s+", " "))


def same_note(a: Column | str, b: Column | str) -> Column:
    return normalize_title(a) == normalize_title(b)


def normalize_path(path: Column | str) -> Column:
    """Lower case, no .md, [-_ ] runs as one blank, no leading ./ or /, backslashes as slashes, trimmed; in that order."""
    p = F.regexp_replace(F.lower(col(path)), r"\.md$", "")
    p = F.regexp_replace(p, r"(?U)[-_\s]+", " ")
    p = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"^/", "")
    return F.trim(F.replace(p, F.lit("\\"), F.lit("/")))


def wikilinks(text: Column | str) -> Column:
    """array<struct<target, section, alias>> of a text's links, in order; line by line, so none spans lines."""
    lines = F.filter(F.split(col(text), "\n"), lambda line: F.contains(line, F.lit("[[")))

    def of_line(line: Column) -> Column:
        part = lambda k: F.regexp_extract_all(line, F.lit(WIKILINK), F.lit(k))
        return F.transform(F.arrays_zip(part(1).alias("t"), part(2).alias("s"), part(3).alias("a")), lambda x: F.struct(F.trim(x["t"]).alias("target"), F.nullif(F.trim(x["s"]), F.lit("")).alias("section"), F.nullif(F.trim(x["a"]), F.lit("")).alias("alias")))

    return F.flatten(F.transform(lines, of_line))


def wikilink_targets(text: Column | str) -> Column:
    """Distinct trimmed targets in order of first mention, over the whole text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x)))


def wikilink_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(WIKILINK))


def repair_targets(text: Column | str) -> Column:
    """Targets as link repair reads them: anything after # or | is skipped, repeats stay."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))


def link_context(text: Column | str, start: Column, end: Column, around: int = 50) -> Column:
    """Up to `around` code points on both sides of a span (0-based, end exclusive), with ellipses, on one line."""
    t = col(text)
    a, b = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(t))
    cut = F.substring(t, a + 1, b - a)
    return F.trim(F.regexp_replace(F.concat(F.when(a > 0, "...").otherwise(""), cut, F.when(b < F.length(t), "...").otherwise("")), r"\n+", " "))


def html_to_text(html: Column | str, cap: int | None = 10_000) -> Column:
    """Scripts and styles dropped, tags as blanks, seven entities decoded, white space collapsed, capped."""
    t = F.regexp_replace(col(html), r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"(?i)</(p|div|h[1-6]|li|tr|br)>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return t if cap is None else F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap), F.lit("..."))).otherwise(t)


def html_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?i)<title[^>]*>([^<]*)</title>", 1))


def html_description(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?i)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)[\"']", 1))


def html_links(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r'href="([^"]*)"'), F.lit(1))


def detect_language(text: Column | str) -> Column:
    """ko, ja, zh or en by counts of Hangul, kana and Han; fewer than ten such characters are en."""
    t = col(text)
    ko, kana, han = (F.regexp_count(t, F.lit(p)) for p in (r"[\x{AC00}-\x{D7AF}]", r"[\x{3040}-\x{30FF}]", r"[\x{4E00}-\x{9FFF}]"))
    return F.when(ko + kana + han < 10, "en").when((ko > kana) & (ko > han), "ko").when(kana > 0, "ja").when(han > ko, "zh").otherwise("en")


def strip_markdown(text: Column | str) -> Column:
    """Fenced code as [code], inline code, emphasis, headings and list marks without their signs."""
    t = F.regexp_replace(col(text), r"```[\s\S]*?```", "[code]")
    for pattern, put in ((r"`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", "• ")):
        t = F.regexp_replace(t, pattern, put)
    return F.trim(t)


def preview(text: Column | str, size: int = 100) -> Column:
    t = col(text)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def highlights(chunks: Column, most: int = 3, size: int = 200) -> Column:
    return F.transform(F.slice(chunks, 1, most), lambda c: F.substring(c, 1, size))


def collapse(text: Column | str, size: int | None = None) -> Column:
    """White space collapsed; cut with an ellipsis when longer than size."""
    t = F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))
    return t if size is None else F.when(F.length(t) > size, F.concat(F.rtrim(F.substring(t, 1, size - 1)), F.lit("…"))).otherwise(t)


def title_case(basename: Column | str) -> Column:
    """Dashes and underscores as blanks, each word's first letter upper-case."""
    return F.array_join(F.transform(F.split(F.regexp_replace(col(basename), r"[-_]", " "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def basename(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.md$", "")


def estimate_tokens(text: Column | str, per_token: int = 3) -> Column:
    return F.ceil(F.length(col(text)) / per_token)


def content_hash(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def cache_key(text: Column | str) -> Column:
    return F.substring(content_hash(text), 1, 16)


def stable_id(text: Column | str, prefix: str = "q-", size: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(col(text).cast("binary")), 1, size))


def run_id(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyyMMdd-HHmmss")


def note_id(ts: Column | str) -> Column:
    return F.concat(F.lit("note_"), F.date_format(col(ts), "yyyyMMdd_HHmmssSSS"))


def relative_time(then: Column | str, now: Column) -> Column:
    """'5 minutes ago', 'in 2 days' and the like: s, min, h, day, week, month of 30 days, year of 365."""
    s = F.unix_timestamp(now) - F.unix_timestamp(col(then))
    a = F.abs(s)
    units = ((60, 1, "second"), (3600, 60, "minute"), (86_400, 3600, "hour"), (604_800, 86_400, "day"), (2_592_000, 604_800, "week"), (31_536_000, 2_592_000, "month"), (None, 31_536_000, "year"))
    text = None
    for below, per, name in units:
        n = F.floor(a / per)
        said = F.concat(n.cast("string"), F.lit(" " + name), F.when(n == 1, "").otherwise("s"))
        if text is None:
            text = F.when(a < below, said)
        else:
            text = text.when(a < below, said) if below else text.otherwise(said)
    return F.when(s >= 0, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))


def relativize(path: Column | str, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(col(path), F.lit(root)), F.substring(col(path), len(root) + 1, 1 << 30)).otherwise(col(path))


def map_folder(path: Column | str, rules: list[tuple[str, str]], default: str = "inbox") -> Column:
    """The target of the first rule whose pattern occurs in a folder of the path, first folder first."""
    folders = F.slice(F.split(F.lower(col(path)), "/"), 1, F.greatest(F.size(F.split(col(path), "/")) - 1, F.lit(0)))

    def hit(folder: Column) -> Column:
        c = F.lit(None).cast("string")
        for pattern, target in reversed(rules):
            c = F.when(F.contains(folder, F.lit(pattern)), F.lit(target)).otherwise(c)
        return c

    return F.coalesce(F.try_element_at(F.filter(F.transform(folders, hit), lambda x: x.isNotNull()), F.lit(1)), F.lit(default))


def image_links(text: Column | str) -> Column:
    """Local image references, ![alt](path) and ![[path]]; web addresses are skipped."""
    md = F.regexp_extract_all(col(text), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    wiki = F.regexp_extract_all(col(text), F.lit(r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.filter(F.concat(md, wiki), lambda p: ~F.startswith(p, F.lit("http")))


def contains_all(text: Column | str, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(F.lower(col(text)), F.lower(t)))


def word_count(text: Column | str) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(col(text), F.lit(r"(?U)\S+"))


def month(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")
