"""Template residue, filler, error pages and script notices in texts.

A regularised linear classifier scores every window of a text's lines and alone decides. Features
are hashed tokens, pairs and triples of tokens (triples by shape: signs stand for themselves, words
and numbers for their kind), the borders of the line, the window's length, whether it is a whole
line, the text's length, and the title: whether there is one, how long it is, and whether the window
repeats it. Labels are weak: windows in which a response status or one of some general phrases
stands are positive; so are windows that stand in several places, always in texts with a positive
one, for which no phrase is needed; other windows of such texts are not used, and all windows of
other texts are negative. A few written examples of either kind are added, so that small tables
can be learnt from. The threshold is set by windows of hosts that the scoring model has not seen.
The phrases only label the sample: they are not looked for in the texts that are judged.

Defined results
  * null, empty and blank texts are no cases; texts of any length are scored whole;
  * repeated rows each count, their ids come out once; extra columns are not read;
  * on tables without residue the written examples alone are the positive ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import written

#: Bounds of the sample that the classifier is fitted on: texts, and distinct windows of each kind.
DOCS, MOST_POSITIVE, MOST_NEGATIVE = 15_000, 20_000, 40_000
#: Parts that the hosts are dealt into; places in which an unlabelled window must stand to count as positive.
FOLDS, PLACES = 8, 3
#: Windows of residue that one falsely taken window outweighs in the choice of the threshold.
COST = 3.0
#: Tokens of a window and between two windows, hashed weights, steps and penalty of the fit.
WINDOW, STRIDE, WIDTH, STEPS, PENALTY = 8, 4, 1 << 18, 80, 4e-6

# Usual words of filler text, and response-status lines.
FILLER = (
    "lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do", "eiusmod", "tempor", "incididunt", "labore", "dolore",
    "magna", "aliqua", "velit", "nulla", "morbi", "vitae", "fusce", "justo", "quam", "nibh", "ornare", "purus", "arcu", "tempus", "eros", "donec",
    "mauris", "lectus", "porta",
)
STATUS = (
    r"bad request|unauthori[sz]ed|forbidden|not found|method not allowed|request time-?out|too many requests|internal server error|"
    r"not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied"
)
# The weak labels' phrases, by family. They are usual wordings of templates, servers and browsers.
FAMILIES: dict[str, tuple[str, ...]] = {
    "double braces": (r"\{\{[^{}\n]{1,80}\}\}",),
    "code tags": (r"\{%[^%\n]{1,80}%\}", r"<%[^%\n]{1,80}%>"),
    "dollar names": (r"\$\{[^{}\n]{1,60}\}", r"\$[a-z_]{3,40}\$"),
    "percent names": (r"%%[a-z_]{2,40}%%", r"@@[a-z_]{2,40}@@"),
    "double brackets": (r"\[\[[^\[\]\n]{1,60}\]\]",),
    "fenced names": (r"(?<!\w)#[a-z_]{3,40}#(?!\w)", r"(?<!\w)__[a-z][a-z_]{1,40}__(?!\w)"),
    "escaped tags": (r"&lt;/?[a-z_]{2,40}&gt;",),
    "single braces": (r"(?<![{$])\{[a-z][a-z_]{2,40}\}(?!\})",),
    "editor's notes": (
        r"\[(?:insert|add|enter|your)\b[^\[\]\n]{0,60}\]", r"\[[^\[\]\n]{1,60} (?:tk|tbd|tba|to come|goes here|here)\]", r"\[placeholder\]",
        r"\[[^\[\]\n]{0,60}\b(?:einfügen|einsetzen|ergänzen|вставить|указать|добавить)\b[^\[\]\n]{0,60}\]",
    ),
    "printed objects": (r"\[object object\]",),
    "latin filler": (r"(?:\b(?:" + "|".join(FILLER) + r")\b[\s.,]*){5,}",),
    "dummy texts": (
        r"\b(?:dummy|sample|placeholder) (?:text|copy|headline|title)\b", r"\btext goes here\b", r"\bblindtext\b", r"\bplatzhalter(?:text)?\b", r"\bhier (?:steht|kommt) [^\n.]{0,30}text",
        r"\bрыба-?текст\b", r"\bздесь (?:будет|должен быть) (?:текст|заголовок)", r"\bтестов(?:ый|ая) (?:текст|заголовок|статья)\b",
    ),
    "tests": (r"\b(test|тест)(?:\W+\1\b){2,}",),
    "status lines": (
        rf"^\W*(?:http )?(?:(?:error|fehler|ошибка) )?\(?[45]\d\d\)?[.:,]?\s*(?:error|{STATUS})?\W*$", rf"^\W*(?:{STATUS})\s*\(?(?:[45]\d\d)?\)?\W*$", r"^\W*http error [45]\d\d",
        r"^\W*(?:page|seite|страница) (?:was )?(?:not|nicht|не) (?:found|gefunden|найдена)\W*$", r"^\W*(?:доступ (?:ограничен|запрещ[её]н)|zugriff (?:verweigert|gesperrt|eingeschränkt))\W*$",
    ),
    "failed pages": (
        r"\bpage you (?:are looking for|requested)\b", r"\b(?:could not|cannot|unable to) (?:complete|process) your request\b", r"\btry again (?:later|in a few)\b",
        r"\b(?:service|сервис|dienst) (?:is )?(?:temporarily|временно|vorübergehend|zurzeit|derzeit) (?:unavailable|недоступен|nicht)\b", r"\bпопробуйте (?:обновить|позже|ещё раз|зайти)", r"\bseite wurde (?:verschoben|gelöscht)\b",
        r"\b(?:laden sie die seite|versuchen sie es) (?:später|erneut|in )", r"\bне удалось загрузить\b", r"\b(?:failed to|could not) load\b", r"\bне загрузил(?:ся|ась|ось)\b", r"\bnicht geladen\b",
    ),
    "script notices": (
        r"\b(?:please|you (?:need|have) to|must) (?:\w+ ){0,2}(?:enable|turn on|allow|activate) (?:javascript|scripts|cookies)\b", r"\benable javascript (?:to|and)\b", r"\bbrowser does not support (?:javascript|scripts)\b",
        r"\bвключите (?:javascript|скрипты)", r"\bнеобходимо включить (?:javascript|скрипты)", r"\bбраузер не поддерживает\b", r"\b(?:bitte )?aktivieren sie (?:bitte )?(?:javascript|skripte)\b", r"\bjavascript (?:aktivieren|einschalten)\b",
        r"\bihr browser (?:unterstützt|blockiert) (?:kein|skripte)", r"\bchecking your browser\b", r"\bпроверяем ваш браузер\b", r"\bihr browser wird (?:geprüft|überprüft)\b",
    ),
}
_FAMILIES = [(i, re.compile("|".join(f"(?:{p})" for p in ps) if len(ps) > 1 else ps[0], re.I | re.M)) for i, ps in enumerate(FAMILIES.values())]

# Written examples: usual texts of either kind.
POSITIVE = (
    "Oops! Something went wrong", "Oops, something went wrong. Please try again later", "An unexpected error occurred", "Unexpected application error", "Application error: a client-side exception has occurred",
    "This site requires cookies to function", "Please enable cookies to continue", "Please enable JavaScript to view this page", "You need to enable JavaScript to run this app", "JavaScript is disabled in your browser",
    "This page requires JavaScript", "Your browser is not supported", "Just a moment, checking your browser before accessing the site", "Sorry, this content is no longer available", "Sorry, the page you requested was not found",
    "The requested URL was not found on this server", "We could not find that page", "This content is not available in your region", "Your request has been blocked", "We have detected unusual traffic from your network",
    "Error code: 503", "HTTP 404", "404 Not Found", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "Access denied", "Page not found", "Failed to load content", "The content failed to load",
    "Notice: Undefined index: title in /var/www/html/index.php on line 27", "Warning: include(): Failed opening file in /var/www/html/page.php on line 3", "Fatal error: Uncaught exception in /srv/www/app.php on line 112",
    "Traceback (most recent call last)", "Error establishing a database connection", "undefined undefined", "null null", "NaN NaN", "[object Object]", "[PLACEHOLDER]", "[TITLE]", "[insert title here]", "{{title}}", "{{ post.content }}",
    "${title}", "%%TITLE%%", "<%= title %>", "{% block content %}", "[[NAME]]", "#NAME#", "__NAME__", "{name}", "{user_name}", "&lt;name&gt;", "@@NAME@@", "$name$", "[name TBD]", "[photo TK]", "[caption to come]", "Text goes here",
    "Your text here", "Click here to edit this text", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua", "Test test test", "Dummy text for layout", "Headline to be replaced", "Sample headline",
    "Что-то пошло не так", "Произошла непредвиденная ошибка", "Страница не найдена", "Запрашиваемая страница не существует", "Ошибка 404", "Ошибка сервера", "Доступ запрещён", "Сервис временно недоступен", "Попробуйте обновить страницу или зайти позже",
    "Материал не загрузился", "Включите JavaScript, чтобы продолжить", "Для работы сайта нужно включить скрипты", "Ваш браузер не поддерживается", "Запросы с вашего адреса заблокированы", "Здесь будет текст", "Тестовый заголовок", "Текст-заглушка", "[вставить имя]", "тест тест тест",
    "Etwas ist schiefgelaufen", "Ein unerwarteter Fehler ist aufgetreten", "Seite nicht gefunden", "Die angeforderte Seite existiert nicht", "Fehler 404", "Zugriff verweigert", "Dienst vorübergehend nicht verfügbar", "Bitte laden Sie die Seite neu", "Bitte versuchen Sie es später erneut",
    "Der Inhalt konnte nicht geladen werden", "Bitte aktivieren Sie JavaScript in Ihrem Browser", "Ihr Browser unterstützt keine Skripte", "Ihre Anfrage wurde blockiert", "Hier steht Ihr Text", "Beispieltext", "Blindtext", "[Name einfügen]", "Platzhaltertext",
)
NEGATIVE = (
    "a1b2c3d4e5f6" * 6, "Its checksum is " + "0f9e8d7c" * 8 + ".", "Text: Anna Schmidt", "Words: John Smith", "Текст: Иван Петров", "Details to follow.", "Weitere Angaben folgen.", "Подробности позже.",
    "Compiled from agency reports.", "Picture: archive.", "Zusammengestellt aus Berichten.", "По сообщениям корреспондентов.", "A leaflet shows how to enable JavaScript, step by step.", "Readers asked how to enable JavaScript and where to allow scripts.",
    "Lessons on how to turn on scripts and cookies drew pensioners.", "The page you are looking for in the chronicle is torn, the curator said.", "The court found that the ministry could not complete the request of the paper.",
    "He said he would try again later this year.", "The report describes error pages and dummy texts found by auditors.",
    "A guide for pensioners explains how to enable JavaScript and why cookies are asked for.", "The library teaches children how to turn on scripts in a browser.", "The town's site showed visitors a 404 error for two days, and the mayor apologised.",
    "An error in the server room left the office without a network, the agency reported.", "The committee said that something went wrong with the tender.", "The page was not found among the papers of the archive.", "The minister denied access to the file, the court heard.",
    "Service on the line was unavailable for three hours on Monday.", "The play “Lorem Ipsum” tells the story of a printer.", "The band named its album “Page Not Found”, critics wrote.", "The set {1, 2, 3} has three members, the teacher said.", "Prices rose by 5 % [the report says] in May.",
    "He called it “a test of patience” and a test of trust.", "The firm checks browsers for faults, its head said.", "The placeholder bill was replaced by a full text in parliament.", "The budget item #4 cost $40 and the other $50.", "A course in JavaScript drew forty pupils.",
    "Сайт города показывал ошибку 404 почти сутки, и мэрия извинилась.", "На курсах школьников учат включать скрипты и писать на JavaScript.", "Сервер области вышел из строя, сообщила служба.", "Страница летописи не найдена в архиве, рассказал историк.", "Доступ к парку ограничен до мая.", "Спектакль «Тест» собрал полный зал.",
    "Die Seite der Stadt zeigte zwei Tage lang den Fehler 404, man bat um Nachsicht.", "Ein Kurs erklärt Senioren, wie man JavaScript aktiviert.", "Der Dienst auf der Strecke war am Montag nicht verfügbar.", "Der Zugriff auf die Akten wurde dem Ausschuss verweigert.", "Der Platzhalter im Gesetz wurde ersetzt.",
)

# Slots of the written examples: usual marks of template languages, and names set into them.
SLOTS = (
    "{{%s}}", "{{ %s }}", "{%% include '%s' %%}", "<%%= %s %%>", "${%s}", "$%s$", "%%%%%s%%%%", "@@%s@@", "[[%s]]", "#%s#", "__%s__", "{%s}", "&lt;%s&gt;", "[insert %s]", "[%s tk]", "[%s to come]", "[%s here]", "[%s einfügen]", "[вставить %s]",
)
NAMES = ("title", "NAME", "user_name", "DATE", "body_text", "LINK_URL")

_token = re.compile(r"[^\W_]+|[^\w\s]+|_+|\n")
_tokens = _token.findall


class Words:
    """Token -> its number and the number of its shape; what a worker keeps is bounded."""

    MOST = 300_000

    def __init__(self) -> None:
        self.ids: dict[str, tuple[int, int]] = {"\n": (0, 0)}

    def of(self, tokens: list[str]) -> np.ndarray:
        import xxhash

        if len(self.ids) > self.MOST:
            self.ids = {"\n": (0, 0)}
        for t in set(tokens).difference(self.ids):
            if not t[0].isalnum():
                word = shape = t[:24]
            elif t.isdigit():
                word = shape = "=status" if len(t) == 3 and t[0] in "45" else "=number"
            elif any(c.isdigit() for c in t):
                word = shape = "=mixed" if len(t) <= 16 else "=long"
            else:
                word, shape = t.lower()[:24], "=capitals" if len(t) > 1 and t.isupper() else "=word"
            self.ids[t] = tuple((xxhash.xxh32_intdigest(x) & 0x7FFFFFFF) | 1 for x in (word, shape))
        return np.array(list(map(self.ids.__getitem__, tokens)), dtype=np.int64).reshape(-1, 2)


@dataclass
class Windows:
    """The windows of some texts: feature numbers of all tokens, and where each window begins and ends."""

    one: np.ndarray  # feature of each token
    two: np.ndarray  # feature of each token with the next
    three: np.ndarray  # feature of the shapes of each token and the two after it
    begin: np.ndarray
    end: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]  # first pair, and the one after the last: with the line's borders
    dense: list[np.ndarray]  # features of the whole window
    text: np.ndarray  # which text it belongs to
    start: np.ndarray  # place of each text's first token


#: Dense features: length and wholeness, place and repetition of the title, length of the text, length of the title.
_DENSE = ((WINDOW + 1) * 2, 4, 8, 8)
SIZE = WIDTH + sum(_DENSE)


def windows(texts: list[str], titles: list[str | None] | None, words: Words) -> Windows:
    """titles is None where texts have none by their nature: no feature of the title is set then."""
    flat: list[str] = ["\n"]
    sizes = []
    for t in texts:
        p = _tokens(t)
        sizes.append(len(p) + 1)
        flat += p
        flat.append("\n")
    h, shape = words.of(flat).T
    sizes = np.array(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    owner = np.concatenate([[0], owner])
    brk = h == 0
    n = len(h)
    ends = np.flatnonzero(brk)  # the first one stands before all texts
    line = np.cumsum(brk) - brk  # line i lies between breaks i - 1 and i
    begin_of = np.concatenate([[0], ends + 1])
    offset = np.arange(n) - begin_of[line]
    size = np.concatenate([ends, [n]])[line] - begin_of[line]
    begin = np.flatnonzero(~brk & (offset % STRIDE == 0) & ((offset == 0) | (size - offset > STRIDE)))
    stop = begin_of[line[begin]] + size[begin]
    end = np.minimum(begin + WINDOW, stop)
    after = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, n), x.dtype)])
    one = (h * 0x9E3779B1 >> 7) % WIDTH
    two = ((after(h, 1) * 0x85EBCA77 ^ h * 0xC2B2AE3D) >> 9) % WIDTH
    three = ((after(shape, 2) * 0x27D4EB2F ^ after(shape, 1) * 0x165667B1 ^ shape * 0x9E3779B1) >> 8) % WIDTH
    first, last = offset[begin] == 0, end == stop
    text = owner[begin]
    start = np.cumsum(sizes) - sizes + 1
    title_keys = np.array([hash(" ".join(_tokens(t.lower()))) if t and t.strip() else 0 for t in titles or [None] * len(texts)])
    head = line[begin] == line[np.minimum(start, n - 1)][text]
    whole = np.flatnonzero(first & last)
    same = np.zeros(len(begin), dtype=bool)
    for i in whole[np.isin(text[whole], np.flatnonzero(title_keys))]:
        same[i] = hash(" ".join(flat[begin[i] : end[i]]).lower()) == title_keys[text[i]]
    log = lambda x: np.minimum(np.log2(np.maximum(x, 1)).astype(np.int64), 7)
    kinds = [(end - begin) * 2 + (first & last), head * 2 + same, np.maximum(log(sizes[text] - 1) - 1, 0)]
    if titles is not None:
        kinds.append(np.array([0 if not t or not t.strip() else 1 + min(6, len(t.split()) // 2) for t in titles])[text])
    at = np.cumsum([WIDTH, *_DENSE])
    dense = [at[i] + np.asarray(x, dtype=np.int64) for i, x in enumerate(kinds)]
    return Windows(one, two, three, begin, end, (begin - first, end - 1 + last), dense, text, start)


@dataclass
class Model:
    weights: np.ndarray
    least: float
    report: list[tuple[str, float]] = field(default_factory=list)

    def scores(self, w: Windows) -> np.ndarray:
        def between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0.0], np.cumsum(self.weights[x], dtype=np.float64)])
            return c[np.maximum(hi, lo)] - c[lo]

        out = between(w.one, w.begin, w.end) + between(w.two, *w.pairs) + between(w.three, w.begin, w.end - 2)
        for d in w.dense:
            out += self.weights[d]
        return out


def _features(w: Windows, i: int) -> np.ndarray:
    """Feature numbers of window i."""
    b, e = w.begin[i], w.end[i]
    return np.concatenate([w.one[b:e], w.two[w.pairs[0][i] : w.pairs[1][i]], w.three[b : max(e - 2, b)], [d[i] for d in w.dense]])


def _labels(text: str, w: Windows, which: np.ndarray, base: int) -> np.ndarray:
    """Per window of one text: the family of a phrase in it, -1 if there is none, -2 if it only touches one."""
    y = np.full(len(which), -1)
    low = text.lower()
    spans = [(m.end() - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), f) for f, p in _FAMILIES for m in p.finditer(low)]
    if spans:
        at = [(m.start(), m.end()) for m in _token.finditer(text)]
        for k, j in enumerate(which):
            a, b = at[w.begin[j] - base][0], at[w.end[j] - base - 1][1]
            for lo, hi, f in spans:
                inside = min(b, hi) - max(a, lo)
                if inside > 0 and y[k] < 0:
                    y[k] = f if inside == hi - lo or inside >= 20 else -2
    return y


def written_examples() -> pd.DataFrame:
    """(fold, y, family, n, feats) of the written examples, each alone and within a plain sentence."""
    shown = [(1, t) for t in (*POSITIVE, *(slot % name for slot in SLOTS for name in NAMES))] + [(0, t) for t in NEGATIVE]
    rows = []
    for i, (y, t) in enumerate(shown):
        words = NEGATIVE[i % len(NEGATIVE)].split(" ")
        head = " ".join(words[: len(words) // 2]) + " "
        for text, lo in ((t, 0), (head + t + " " + " ".join(words[len(words) // 2 :]), len(head)))[: 1 + y]:
            w = windows([text], None, _words)
            at = [(m.start(), m.end()) for m in _token.finditer(text)]
            families = [f for f, p in _FAMILIES if p.search(t.lower())]
            for j in range(len(w.begin)):
                inside = min(at[w.end[j] - 2][1], lo + len(t)) - max(at[w.begin[j] - 1][0], lo)
                if y == 0 or inside >= min(20, len(t)):
                    rows.append((-1, y, families[0] if y and families else -1, 1 if y else 16, _features(w, j)))
    return pd.DataFrame(rows, columns=["fold", "y", "family", "n", "feats"])


_words = Words()
_EXAMPLE = "fold int, content bigint, before bigint, family int, marked int, feats array<int>"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of sampled texts: label, whether the text has a phrase, and the line before."""
    import xxhash

    names = ["fold", "content", "before", "family", "marked", "feats"]
    for b in batches:
        for i in range(0, b.num_rows, 64):
            fold, titles, texts = (c.to_pylist() for c in b.slice(i, 64).columns)
            w = windows(texts, titles, _words)
            cols: list[list] = [[] for _ in names]
            cut = np.searchsorted(w.text, np.arange(len(texts) + 1))
            for t in range(len(texts)):
                which = np.arange(cut[t], cut[t + 1])
                y = _labels(texts[t], w, which, w.start[t])
                marked = int((y >= 0).any())
                last = 0
                for j, f in zip(which, y, strict=True):
                    feats = _features(w, j)
                    content = xxhash.xxh64_intdigest((w.one[w.begin[j] : w.end[j]] * 31 + w.three[w.begin[j] : w.end[j]]).tobytes()) - (1 << 63)
                    # The dense features of a window do not tell its content: copies of a line are one example.
                    for col, x in zip(cols, (fold[t], content, last, int(f), marked, feats), strict=True):
                        col.append(x)
                    last = content
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


@dataclass
class Sample:
    """Distinct windows per fold, with feature lists in one array."""

    fold: np.ndarray
    y: np.ndarray
    family: np.ndarray
    count: np.ndarray
    size: np.ndarray
    feats: np.ndarray

    def matrix(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.cumsum(keep) - 1, np.where(keep, self.size, 0)), self.feats[np.repeat(keep, self.size)]


def sample(articles: DataFrame, key: str, host: str, title: str, body: str) -> Sample:
    """The labelled windows of at most DOCS texts, chosen by a hash of their ids.

    Counting by content and fold runs in Spark; windows are chosen in proportion to their number; at most MOST_POSITIVE + MOST_NEGATIVE distinct
    windows, each of at most four features a token, come to the driver.
    """
    some = articles.where(F.length(F.trim(body)) > 0).select(F.xxhash64(F.col(key), F.lit(5)).alias("h"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(title).alias("title"), F.col(body).alias("body"))
    last = some.select("h").orderBy("h").limit(DOCS).agg(F.max("h")).first()[0]
    near = some.where(F.col("h") <= F.lit(-(2**63) if last is None else last).cast("bigint"))
    rows = near.select(F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"), "title", "body").repartition(16).mapInArrow(_examples, _EXAMPLE)
    each = rows.groupBy("fold", "content").agg(
        F.max("family").alias("family"), F.min("family").alias("least"), F.count("*").alias("n"), F.sum("marked").alias("n_marked"), F.approx_count_distinct("before").alias("places"), F.first("feats").alias("feats"),
    )
    phrase, alone = F.col("family") >= 0, (F.col("n_marked") == F.col("n")) & (F.col("least") > -2)
    each = each.withColumn("y", F.when(phrase, 1).when(alone & (F.col("places") >= PLACES), 1).when(F.col("n_marked") < F.col("n"), 0))
    each = each.where("y is not null").withColumn("r", F.pmod(F.xxhash64("content"), F.lit(1 << 40)) / F.col("n"))
    cols = ["fold", "y", "family", "n", "feats"]
    each = written(each, "examples")
    got = [each.where(F.col("y") == y).orderBy("r", "fold").limit(m).select(cols).toPandas() for y, m in ((1, MOST_POSITIVE), (0, MOST_NEGATIVE))]
    got.append(written_examples())
    all_ = pd.concat([g for g in got if len(g)], ignore_index=True)
    size = all_["feats"].map(len).to_numpy()
    return Sample(
        all_["fold"].to_numpy(), all_["y"].to_numpy(), all_["family"].to_numpy(), all_["n"].to_numpy(float),
        size, np.concatenate(all_["feats"].to_list()).astype(np.int64),
    )


def _weights(s: Sample, keep: np.ndarray) -> np.ndarray:
    """Logistic regression with an L2 penalty and balanced classes, by Adam over the kept examples."""
    rows, feats = s.matrix(keep)
    y, weight = s.y[keep].astype(float), np.sqrt(np.minimum(s.count[keep], 25.0))
    used, feats = np.unique(feats, return_inverse=True)
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    share = weight @ y / weight.sum()
    weight = weight * np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) / weight.sum()
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[feats], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(feats, ((p - y) * weight)[rows], minlength=len(used)) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    out = np.zeros(SIZE)
    out[used] = w
    return out


def _scored(s: Sample, weights: np.ndarray, keep: np.ndarray) -> np.ndarray:
    rows, feats = s.matrix(keep)
    return np.bincount(rows, weights[feats], minlength=int(keep.sum()))


def fit(articles: DataFrame, key: str = "id", host: str = "source_id", title: str = "title", body: str = "body_text", families: bool = False) -> Model:
    """The model of all folds; its threshold and report come from models that have not seen the host.

    With families, each family of phrases is also left out of the training, together with the held
    out hosts, and then looked for among these.
    """
    s = sample(articles, key, host, title, body)
    score = np.full(len(s.y), np.nan)
    for k in range(FOLDS):
        out = s.fold == k
        if out.any():
            score[out] = _scored(s, _weights(s, ~out), out)
    seen = ~np.isnan(score)
    pos, neg = seen & (s.y == 1), seen & (s.y == 0)
    # The threshold with the fewest errors on unseen hosts, in the middle of its stretch.
    least = 0.0
    if pos.any() and neg.any():
        order = np.argsort(score[seen])
        x, y, n = score[seen][order], s.y[seen][order], s.count[seen][order]
        wrong = np.concatenate([[0], np.cumsum(n * (y == 1))]) + COST * ((n * (y == 0)).sum() - np.concatenate([[0], np.cumsum(n * (y == 0))]))
        edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
        best = np.flatnonzero(wrong <= wrong.min() + 0.005 * (n * (y == 1)).sum())
        least = float(np.clip((edges[best[0]] + edges[best[-1]]) / 2, 1.0, 2.0))

    def measures(name: str, positive: np.ndarray, n: np.ndarray) -> list[tuple[str, float]]:
        hit = float((n * (positive > least)).sum())
        return [(f"{name}: positive windows", float(n.sum())), (f"{name}: recall", hit / max(1.0, n.sum())), (f"{name}: precision", hit / max(1.0, hit + false))]

    false = float((s.count[neg] * (score[neg] > least)).sum())
    report = [("threshold", least), ("negative windows", float(s.count[neg].sum())), *measures("unseen hosts", score[pos], s.count[pos])]
    if families:
        for f, name in enumerate(FAMILIES):
            found, counts = [np.zeros(0)], [np.zeros(0)]
            for k in range(FOLDS):
                out = s.fold == k
                asked = out & (s.family == f)
                if asked.any():
                    found.append(_scored(s, _weights(s, ~out & (s.family != f)), asked))
                    counts.append(s.count[asked])
            report += measures(f"unseen hosts and phrases, {name}", np.concatenate(found), np.concatenate(counts))
    return Model(_weights(s, np.ones(len(s.y), dtype=bool)), least, [(name, float(x)) for name, x in report])


def flagged(df: DataFrame, text: str, model, key: str = "id", title: str | None = None) -> DataFrame:
    """(row_id, score): rows whose text has residue. model is the broadcast model; one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(1).to_pylist()
                w = windows(texts, part.column(2).to_pylist() if title else None, _words)
                best = np.full(len(texts), -np.inf)
                np.maximum.at(best, w.text, m.scores(w))
                hits = np.flatnonzero(best > m.least)
                if len(hits):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hits)), pa.array(best[hits], pa.float64())], ["row_id", "score"])

    about = F.col(title) if title else F.lit(None).cast("string")
    some = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), about.alias("title")).where(F.col("text").rlike(r"[^\s\x{A0}]"))
    return some.mapInArrow(run, "row_id bigint, score double")


def residue_rows(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tbl, row_id) of the articles and chunks to set aside."""
    model = articles.sparkSession.sparkContext.broadcast(fit(articles))  # SIZE weights
    a = flagged(articles, "body_text", model, title="title").select(F.lit("articles").alias("tbl"), "row_id").distinct()
    c = flagged(chunks, "chunk_text", model).select(F.lit("article_chunks").alias("tbl"), "row_id").distinct()
    return a.unionByName(c)


def validation(articles: DataFrame) -> DataFrame:
    """(measure, value): accuracy on hosts, and on hosts and phrases, that the model has not seen."""
    schema = T.StructType([T.StructField("measure", T.StringType()), T.StructField("value", T.DoubleType())])
    return articles.sparkSession.createDataFrame(fit(articles, families=True).report, schema)
