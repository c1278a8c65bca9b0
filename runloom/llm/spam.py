"""Keyword-stuffed pages and link lists.

Each text is cut into lines and sentences; a line is material of the project (logs, traces, code, tables, lists of
files and tests), or its sentences are prose (enough words, function words among them, an end), and what is left are
bare phrases and links. From the whole text come density, entropy, repetition and function-word features. Per
language a robust centre (medians) and scatter (of scores wrapped to a few deviations) over all documents give each document a Mahalanobis
distance, in which the bulk of ordinary documents is small and spam cannot inflate the scatter. Documents far out and
in the directions in which spam lies are flagged: the distance decides. An exact check follows, that the greater part of a flagged
text is bare phrases, tags and links without sentences.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import spread, stored

# Function words by language.
FUNCTION_WORDS = {
    "en": "a an the and or but if of to in on at by for with from as is are was were be been it its this that these those he she we they you i our my their not no has have had do does did can could should would will may once when while because since until before after than then so also only still again which what who where why how there here needs need takes take every each without whether nobody somebody anybody it's that's don't didn't doesn't isn't we've they'll i'll i'd can't won't your about into over under same other another",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber wenn weil dass nicht ist sind war wird wurde werden hat haben wir sie er es ich zu im in am an auf aus bei mit nach seit von vor für obwohl nur dann durch noch auch als wie so zur zum über unter denselben",
    "fr": "le la les un une des du de et ou mais si que qui quoi ne pas est sont a ont été sera on nous vous ils elle il je ce cette ces son sa ses dans sur avec pour par plus depuis lorsque bien quand car au aux en y se",
    "es": "el la los las un una unos unas y o pero si que no es son fue ha han se su sus en de del al a con por para desde cuando aunque porque más muy todavía solo lo le nos está están como",
    "pt": "o a os as um uma uns umas e ou mas se que não é são foi há em no na nos nas de do da dos das ao à com por para desde quando embora porque mais só está estão muito ainda como",
    "ru": "и в во не на я что он она они мы вы с со как а то все но это из у за от по для о об же бы к до при или если когда потому так только уже после был была было были хотя чем его её их",
}
# Words that offer something for sale; a short sentence with one of them is no prose.
OFFER_WORDS = "buy buys cheap cheapest best much price prices sale sell sells offer offers discount deal coupon trial subscription kaufen günstig angebot gutschein acheter achat cher promo comprar barato barata oferta preço desconto купить дешево цена скидка"
ELIDED = ("l'", "d'", "n'", "s'", "c'", "j'", "qu'", "m'", "t'")
WORDS = frozenset(w for v in FUNCTION_WORDS.values() for w in v.split())
OFFERS = frozenset(OFFER_WORDS.split())
CJK_LETTERS = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"
CJK_PARTICLES = r"[はがをにでともへや]|ます|です|ません|した|から|まで|[的了在是和不就也都很被把对]|因为|之后|所以|如果|时|은|는|이|가|을|를|에|다"
HIDDEN = r"[\u200b-\u200f\u2060\ufeff\u00ad]"
LINK = r"(?i)(?:https?://|www\.)[^\s<>\"')\]]+|\b(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}/[^\s<>\"')\]]*"
MARKUP = r"(?i)<[^<>\n]+>|\[/?(?:url|b|i|img)\b[^\[\]\n]*\]"
# Forms of lines that are material of the project. The first ones are told by how a line begins, ...
BEGINS = "|".join(
    [
        r"at\s[\w.$/<>]+\(|Caused by|\.\.\. \d+ more|[\w.$]+(?:Exception|Error)\b",  # traces
        r"\W*\d\d:\d\d:\d\d\b|\W*\[?(?:INFO|WARN|ERROR|DEBUG)\b",  # logs
        r"(?:public|private|protected|import|package|class)\s|```",  # code
        r"(?:[a-z]\w*\.){2,}[A-Z]\w*\s*$",  # lists of classes
        r"diff |@@|index [0-9a-f]",  # changes
        r"[-=+*#~_]{4,}\s*$",  # rules
    ]
)
# ... those of commands, tables and code by their first or last characters, which a list of phrases may have too: in short lines only, ...
BEGINS_SHORT = r"\+ \w|\$ |[@}]|\|.*\|$"
CALL = r"\w\([^\n]{0,200}\)\s*[;{]"
RESULT = r"(?:Test|IT|TestCase|Spec)\b.{0,200}\b(?:PASS|PASSED|FAIL|FAILED|ERROR|SKIPPED)\b"
# ... and those of digests and paths inside a line: all of a short line, of a long one what they cover.
DIGEST = r"\b[0-9a-f]{16,}\b"
PATH = r"(?:^|\s)[\w.-]+(?:/[\w.-]+)+\.\w{1,6}(?=[\s:|,]|$)"
SHORT_LINE = 400
SENTENCE_END = r"[.!?…][\"')\]]?\s+|(?<=\w):\s+|[。！？]"  # a title before a colon stands for itself
SEPARATORS = r"[,;|·/•>=\t«»–—、]|\s-\s"
WORD = r"[^\W\d_](?:[\w'’]*\w)?"
JOINT = r"[^\w'’]+|_+"  # between words joined without blanks
LONG_WORD = 200  # longer ones are looked into
CJK_WEIGHT = 2.5  # a CJK letter says as much as so many others

FEATURES = ("links", "bare", "function_words", "repetition", "entropy", "prose")
DIRECTION = np.array([1.0, 1.0, -1.0, 1.0, -1.0, -1.0])
FLOOR = np.array([0.04, 0.08, 0.05, 0.08, 0.06, 0.08])  # least deviation that counts as one
PRIOR_WORDS = 12.0  # short texts are drawn towards an ordinary one by so many words
ORDINARY = np.array([0.0, 0.0, 0.35, 0.2, 0.9, 1.0])
FAR = 64.0  # squared distance: eight robust deviations
TOWARD = 0.15  # least cosine between a deviation and the direction of spam
WRAP = 3.0
BLOCK = 200  # pairs of words
LEAST_GROUP = 200  # languages of fewer documents share one scatter


def is_function_word(word: str) -> bool:
    return word in WORDS or ("'" in word and word.startswith(ELIDED))


class Reader:
    """Features of one text after the other."""

    def __init__(self):
        import re

        import regex  # its letters include the marks that go with them

        made = {"link": LINK, "markup": MARKUP, "begins": BEGINS, "begins_short": BEGINS_SHORT, "call": CALL, "result": RESULT, "digest": DIGEST, "path": PATH, "sentence": SENTENCE_END, "sep": SEPARATORS, "joint": JOINT, "cjk": CJK_LETTERS, "particle": CJK_PARTICLES, "hidden": HIDDEN}
        self.re = {k: re.compile(v) for k, v in made.items()}
        self.ascii_word, self.word = re.compile(WORD), regex.compile(WORD)

    def words(self, text: str) -> list[str]:
        return (self.ascii_word if text.isascii() else self.word).findall(text.lower())

    def sentences(self, line: str) -> Iterator[str]:
        at = 0
        for m in self.re["sentence"].finditer(line):
            yield line[at : m.end()]
            at = m.end()
        yield line[at:]

    def project(self, line: str) -> bool:
        """Whether a line as a whole is material of the project."""
        if self.re["begins"].match(line):
            return True
        if len(line) > SHORT_LINE:
            return False
        if line[-1] in ";{}" or self.re["begins_short"].match(line) or ("(" in line and self.re["call"].search(line)):
            return True
        if ("PASS" in line or "FAIL" in line or "ERROR" in line or "SKIPPED" in line) and self.re["result"].search(line):
            return True
        return bool(self.re["digest"].search(line) or ("/" in line and self.re["path"].search(line)))

    def weight(self, text: str) -> float:
        """Letters and digits, CJK letters by their weight; runs of a few characters count nothing, words joined without blanks each by itself."""
        words = text.split()
        if not words:
            return 0.0
        if text.isascii():
            n = sum(map(len, words))
            return float(n if n <= LONG_WORD or max(map(len, words)) <= LONG_WORD else sum(len(w) if len(w) <= LONG_WORD else self.joined(w) for w in words))
        n = sum(len(w) if len(w) <= LONG_WORD else self.joined(w) for w in words if len(w) < 6 or len(set(w)) > 2)
        return n + (CJK_WEIGHT - 1) * len(self.re["cjk"].findall(text))

    def joined(self, word: str) -> int:
        """The weight of an overlong word: that of its pieces with letters that are no runs."""
        pieces = self.re["joint"].split(word)
        return sum(len(p) for p in pieces if not (p.isdigit() or (len(p) >= 6 and len(set(p)) <= 2) or (len(p) > LONG_WORD and len(set(p)) <= 4)))

    def prose(self, sentence: str, words: list[str]) -> bool:
        letters = len(self.re["cjk"].findall(sentence)) if not sentence.isascii() else 0
        if letters >= 6 and letters > 0.25 * len(sentence.replace(" ", "")):
            particles = len(self.re["particle"].findall(sentence))
            return particles >= 2 and particles >= 0.1 * letters
        if sentence[-1:] not in ".!?。！？…\"')”»’":
            return False
        n, f = len(words), sum(map(is_function_word, words))
        if n >= 7:
            return f >= 1 and f >= 0.14 * n and n >= 2.5 * (len(self.re["sep"].findall(sentence)) + 1) and len(set(words)) >= 0.6 * n
        return n >= 3 and f >= 1 and f >= 0.15 * n and len(set(words)) == n and not any(w in OFFERS for w in words)

    def read(self, text: str | None) -> tuple[np.ndarray, float]:
        """(features, share of bare phrases and links)."""
        prose = project = bare = links = near = 0.0
        words: list[str] = []
        short: dict[tuple, list[float]] = defaultdict(list)
        text = text or ""
        for line in (text if text.isascii() else self.re["hidden"].sub("", text)).splitlines():
            line = line.strip()
            if not line:
                continue
            found = self.re["link"].findall(line) if "/" in line or "www." in line.lower() else []
            markup = "<" in line or "[" in line
            if not found and not (markup and self.re["markup"].search(line)):
                if self.project(line):
                    project += self.weight(line)
                    continue
                if len(line) > SHORT_LINE:
                    for kind, needs in (("digest", ""), ("path", "/"), ("result", ""), ("call", "(")):
                        if needs in line:
                            parts: list[str] = []
                            line = self.re[kind].sub(lambda m: parts.append(m.group()) or " ", line)  # noqa: B023
                            project += sum(map(self.weight, parts))
            link = float(sum(map(len, found)))
            rest = self.re["link"].sub(" ", line) if found else line
            if markup:
                plain = self.re["markup"].sub(" ", rest)
                link += len(rest) - len(plain)
                rest = plain
            good = bad = title = 0.0
            for sentence in self.sentences(rest):
                sentence = sentence.strip().strip(" \t>*-")
                own = self.words(sentence)
                if own:
                    words += own
                    weight = self.weight(sentence)
                    if sentence.endswith(":"):  # goes with what it is the title of
                        title += weight
                    elif self.prose(sentence, own):
                        weight, title = weight + title, 0.0
                        good += weight
                        if len(own) <= 4 and 2 * sum(map(is_function_word, own)) <= len(own) and not self.re["cjk"].search(sentence):
                            short[tuple(own)].append(weight)
                    else:
                        bad, title = bad + weight + title, 0.0
            bad += title
            prose += good
            bare += bad
            if good >= 20 and good >= bad:
                near += link  # a link with sentences about it
            else:
                links += link
        again = sum(sum(w) for w in short.values() if len(w) >= 3)  # a few words over and over are no prose
        prose, bare = prose - again, bare + again
        total = prose + project + bare + links + near
        case, n = bare + links, len(words)
        if not total:
            return ORDINARY.copy(), 0.0
        counts = Counter(words)
        f = sum(c for w, c in counts.items() if is_function_word(w))
        entropy = -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(max(2, min(n, 200))) if n else 1.0
        pairs = list(zip(words, words[1:]))  # block by block, since a long text repeats by its length alone
        repeated = sum(len(b) - len(set(b)) for b in (pairs[k : k + BLOCK] for k in range(0, len(pairs), BLOCK))) / max(1, len(pairs))
        raw = np.array([links / total, bare / total, f / n if n else ORDINARY[2], repeated, min(1.0, entropy), (prose + project + near) / total])
        size = np.array([total / 6, total / 6, n, n, n, total / 6])  # in words; texts without blanks have few to tell by
        return (raw * size + ORDINARY * PRIOR_WORDS) / (size + PRIOR_WORDS), case / total


def page_features(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, features..., share) of each document, from its whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                read = [reader.read(t) for t in part["text"]]
                out = pd.DataFrame(np.array([r[0] for r in read]).reshape(-1, len(FEATURES)), columns=list(FEATURES))
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                out.insert(1, "lang", part["lang"].to_numpy())
                out["share"] = [r[1] for r in read]
                yield out

    lang = F.coalesce(F.lower(F.trim("lang")), F.lit(""))
    return spread(documents.select("doc_id", lang.alias("lang"), "text")).mapInPandas(run, "doc_id bigint, lang string, " + ", ".join(f"{f} double" for f in FEATURES) + ", share double")


def robust_scatter(pages: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each language (and "" for all together, which also serves the languages of few documents): medians, deviations, inverse of the
    scatter, over all documents: three small aggregates.
    """
    sizes = pages.groupBy("lang").count().where(F.col("count") >= LEAST_GROUP).collect()
    own = [r["lang"] for r in sizes if r["lang"]]
    grouped = pages.withColumn("g", F.when(F.col("lang").isin(own), F.col("lang")).otherwise("") if own else F.lit(""))
    every = grouped.unionByName(grouped.withColumn("g", F.lit(""))) if own else grouped
    middle = {r["g"]: np.array([r[f] for f in FEATURES]) for r in every.groupBy("g").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES]).collect()}
    at = F.create_map(*[x for g, m in middle.items() for x in (F.lit(g), F.array(*map(F.lit, m.tolist())))]) if middle else None
    if at is None:
        return {}
    off = every.select("g", *[F.abs(F.col(f) - at[F.col("g")][k]).alias(f) for k, f in enumerate(FEATURES)])
    spread = {r["g"]: np.maximum(1.4826 * np.array([r[f] for f in FEATURES]), FLOOR) for r in off.groupBy("g").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES]).collect()}
    scale = F.create_map(*[x for g, s in spread.items() for x in (F.lit(g), F.array(*map(F.lit, s.tolist())))])
    z = every.select("g", *[F.greatest(F.lit(-WRAP), F.least(F.lit(WRAP), (F.col(f) - at[F.col("g")][k]) / scale[F.col("g")][k])).alias(f) for k, f in enumerate(FEATURES)])
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    out = {}
    for r in z.groupBy("g").agg(*[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"m{i}_{j}") for i, j in pairs]).collect():
        m = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        d = np.sqrt(np.maximum(np.diag(m), 0.05))
        correlation = m / np.outer(d, d)
        np.fill_diagonal(correlation, 1.0)
        # deviations are already in robust units; half of the identity keeps nearly dependent features apart
        out[r["g"]] = middle[r["g"]], spread[r["g"]], np.linalg.inv(0.5 * correlation + 0.5 * np.eye(len(FEATURES)))
    return out


def judged_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, distance, toward, share, is_spam) for each row of ``documents`` (doc_id, text, lang).

    distance: squared robust Mahalanobis distance; toward: the cosine, in the metric of the scatter, between the deviation and the direction
    of spam; share: of the text that is bare phrases, tags and links without sentences. Null, empty and blank texts
    and runs of repeated characters are ordinary. Repeated rows are judged alike; other columns are ignored.
    """
    pages = stored(page_features(documents), "pages")
    scatter = robust_scatter(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id", "lang", "share"]].copy()
            out["distance"], out["toward"] = 0.0, 0.0
            group = pdf["lang"].where(pdf["lang"].isin(list(scatter)), "")
            for g in group.unique():
                at = np.flatnonzero((group == g).to_numpy())
                middle, spread, inverse = scatter[g]
                z = (pdf[list(FEATURES)].to_numpy()[at] - middle) / spread
                d2 = np.einsum("ni,ij,nj->n", z, inverse, z)
                along = z @ inverse @ DIRECTION / math.sqrt(DIRECTION @ inverse @ DIRECTION)
                out.iloc[at, out.columns.get_loc("distance")] = d2
                out.iloc[at, out.columns.get_loc("toward")] = along / np.sqrt(np.maximum(d2, 1e-12))
            out["is_spam"] = (out["distance"] > FAR) & (out["toward"] > TOWARD) & (out["share"] > 0.5)
            yield out[["doc_id", "lang", "distance", "toward", "share", "is_spam"]]

    return pages.mapInPandas(run, "doc_id bigint, lang string, distance double, toward double, share double, is_spam boolean")
