"""Column builders for text, urls, dates and query terms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is squeezed: the ASCII kind and the no-break space, in a form all dialects read alike.
BLANK = r"[\t\n\x0B\f\r \x{A0}]+"
TOKEN = r"[0-9A-Za-zА-Яа-яЁё]{2,}"

# Word lists of the retrieval rules.
STOPWORDS = (
    "что", "как", "где", "когда", "это", "эта", "этот", "эти", "про", "для", "при", "или", "его", "ее", "её", "она", "они", "оно", "есть", "был",
    "была", "были", "так", "еще", "ещё", "уже", "над", "под", "без", "после", "перед", "между", "если", "чем", "ли", "же", "по", "на", "в", "во",
    "из", "к", "ко", "с", "со", "о", "об", "от", "до", "за", "не", "а", "и", "но",
)
BROAD_TERMS = (
    "россия", "россии", "россию", "россий", "страна", "страны", "сша", "европа", "европы", "москва", "москвы", "украина", "украины", "украину",
)
ACTION_TERMS = (
    "block", "blocking", "ban", "banned", "restrict", "restriction", "restrictions", "arrest",
)
ENDINGS = (
    "иями", "ями", "ами", "его", "ого", "ему", "ому", "иях", "ах", "ях", "ия", "ья", "ие", "ые", "ой", "ий", "ый", "ая", "яя", "ое", "ее", "ам", "ям",
    "ом", "ем", "ов", "ев", "ей", "ию", "ью", "ых", "их", "ую", "юю", "а", "я", "ы", "и", "е", "у", "ю", "о",
)
NOISE = r"ваш браузер не поддерживает|данный формат видео|смотрите видео|подпишит|ria\.ru/[0-9]+"


def squeeze(c: Column) -> Column:
    """One blank for each stretch of white space, none outside."""
    return F.trim(F.regexp_replace(c, BLANK, " "))


def body(c: Column) -> Column:
    """Lines squeezed, empty ones dropped, joined as paragraphs."""
    lines = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, squeeze), lambda x: x != ""), "\n\n")


def optional(c: Column) -> Column:
    """The squeezed text, null if nothing is left."""
    return F.nullif(squeeze(c), F.lit(""))


def content_hash(normal_body: Column) -> Column:
    return F.sha2(normal_body, 256)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda t: t != ""))


def url(c: Column) -> Column:
    """Scheme and host in lower case, https by default, one closing slash, fragment, empty and utm parameters dropped."""
    told = F.trim(F.coalesce(c, F.lit("")))
    full = F.when(told.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), told).otherwise(F.concat(F.lit("https://"), told))
    plain = F.regexp_replace(full, "#.*$", "")
    head, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"\?(.*)$", 1)
    origin = F.lower(F.regexp_extract(head, "^([^:]+://[^/]*)", 1))
    path = F.regexp_replace(F.regexp_extract(head, "^[^:]+://[^/]*(/.*)$", 1), "/$", "")
    params = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.") & ~F.lower(p).startswith("utm_"))
    return F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def compact(c: Column) -> Column:
    """A date text in the sortable form yyyyMMdd'T'HHmm: of texts with dashes, the first 16 signs without - and :."""
    return F.when(F.instr(c, "-") > 0, F.regexp_replace(F.substring(c, 1, 16), "[-:]", "")).otherwise(c)


def bound(value: str | None) -> str | None:
    """A date bound given by the caller in the same form (on the driver)."""
    if value is None or not (v := value.strip()):
        return None
    if "T" not in v:
        digits = re.sub(r"\D", "", v)
        return f"{digits}T0000" if len(digits) == 8 else v
    day, time = v.split("T", 1)
    d, t = re.sub(r"\D", "", day)[:8], re.sub(r"\D", "", time)[:4].ljust(4, "0")
    return f"{d}T{t}" if len(d) == 8 else v


def period(c: Column) -> Column:
    """The calendar month of a date text: its first six signs besides - : T and blanks."""
    return F.substring(F.translate(c, "-:T ", ""), 1, 6)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stem(token: Column, endings: tuple[str, ...] | None = None) -> Column:
    """The token without its first listed ending that leaves four letters."""
    return F.regexp_replace(token, "^(.{4,}?)(?:" + "|".join(endings or ENDINGS) + ")$", "$1")


def stem_text(token: str, endings: tuple[str, ...] | None = None) -> str:
    return re.sub("^(.{4,}?)(?:" + "|".join(endings or ENDINGS) + ")$", r"\1", token)


@dataclass(frozen=True)
class Query:
    """A query's terms and what follows from them; made on the driver, used as literals."""

    text: str
    terms: tuple[tuple[str, str], ...] = field(default=())

    @classmethod
    def of(cls, text: str, stopwords: tuple[str, ...] | None = None) -> Query:
        stop, seen, out = set(stopwords or STOPWORDS), set(), []
        for raw in re.findall(TOKEN, text.lower()):
            if raw in stop or len(s := stem_text(raw)) < 2 or s in stop or s in seen:
                continue
            seen.add(s)
            out.append((raw, s))
        return cls(text, tuple(out))

    @property
    def prefixes(self) -> list[str]:
        """Raw forms and stems of at least three letters, each once, in order."""
        return list(dict.fromkeys(x for t in self.terms for x in t if len(x) >= 3))

    @property
    def anchors(self) -> list[str]:
        long = [s for _, s in self.terms if len(s) >= 5 and s not in BROAD_TERMS]
        if not long and len(self.terms) >= 2:
            long = [max((s for _, s in self.terms), key=len)]
        return list(dict.fromkeys(long))

    @property
    def narrow(self) -> bool:
        return len(self.terms) >= 2 and len(self.anchors) >= 2 and any(s in ACTION_TERMS for _, s in self.terms)


def haystack(title: Column, text: Column) -> Column:
    """Distinct raw tokens and stems of title and text: what query terms are looked up in."""
    raw = tokens(F.concat_ws(" ", title, text))
    return F.array_union(raw, F.transform(raw, lambda x: stem(x)))


def overlap(hay: Column, query: Query) -> Column:
    """Share of the query's terms of which the raw form or stem is in hay."""
    if not query.terms:
        return F.lit(0.0)
    hits = [(F.array_contains(hay, raw) | F.array_contains(hay, s)).cast("int") for raw, s in query.terms]
    return sum(hits[1:], hits[0]).cast("double") / len(hits)


def anchor_matches(hay: Column, query: Query) -> Column:
    return F.size(F.array_intersect(hay, F.array(*map(F.lit, query.anchors)).cast("array<string>")))


def anchor_share(hay: Column, query: Query) -> Column:
    return anchor_matches(hay, query).cast("double") / len(query.anchors) if query.anchors else F.lit(0.0)


def quality(text: Column) -> Column:
    """A chunk's worth by its emptiness, noise and length, as a step."""
    low, n = F.lower(text), F.size(tokens(text))
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", -0.80).when(low.rlike(NOISE), -0.65)
        .when(n < 8, -0.28).when(n < 18, -0.08).when(n > 260, -0.05).otherwise(0.06)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 for empty, unequal, null or zero ones."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    norm = F.sqrt(square(a) * square(b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0) & ~F.isnan(norm), dot / norm), F.lit(0.0))


def hashed_embedding(c: Column, width: int = 16) -> Column:
    """A deterministic stand-in for an embedding model: token counts by the first sign of their md5."""
    signs = F.array_join(F.transform(tokens(c), lambda x: F.substring(F.md5(x), 1, 1)), "")
    counts = lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(f"{i:x}"), F.lit("")))).cast("double") for i in range(width)])
    return F.get(F.transform(F.array(signs), lambda s: counts(s)), F.lit(0))  # the signs are made once


def salvage_object(raw: Column) -> Column:
    """The JSON object in a text: the text itself, or from its first { to its last }; null if neither is one."""
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    good = lambda x: F.when(F.trim(x).startswith("{") & F.try_parse_json(x).isNotNull(), F.trim(x))
    return F.coalesce(good(raw), good(inner))
