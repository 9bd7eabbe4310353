"""Replacement of personal data by keyed surrogates.

Detected entities are e-mail addresses, phone numbers, IPv4 addresses, card and account numbers, social security numbers, secrets after
a key word, names after a form of address, and further mentions of such a name, whole or its last word, in the same text. What is
replaced are the entity's parts: a name falls into first names and a family name, an address into its local part and its
domain. A part's surrogate follows from a secret key, the part's sort and its canonical form, so every mention, in any document, gets
the same one, and people of one family or addresses of one domain stay related. Surrogates keep the mention's own format: letters stay letters of
their script and case, digits stay digits of theirs, separators stay, card and account numbers keep valid check digits, first
names keep the gender of the form of address (one without gender takes the gender that the same first name has elsewhere).

Distinctness is checked over the whole corpus: the distinct parts are gathered with their surrogates, and where two share one, or
a surrogate is itself a part of the corpus, it is drawn again. The space that is drawn from grows with each attempt by a
character or syllable, so every clash ends, however small the first space was. Only these exceptions travel back to the texts.

Defined results: a null text stays null, an empty one empty; a mention without a letter or digit (``password: ________``) is no entity; repeated
rows are treated alike; an empty table gives an empty result; other columns pass through unchanged (``n_chars``, where present, follows
the new text), whatever their names; very long texts are scanned whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.llm.common import unused, written

#: Exceptions up to which they are broadcast.
BROADCAST_ROWS = 100_000

#: Forms of address and the gender they tell (f, m, or none).
ADDRESS = {"Mrs.": "f", "Ms.": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Mr.": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Dr.": "", "Prof.": ""}
SYLLABLES = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "pe", "po", "ra", "re", "ri", "ro", "sa", "se", "so", "ta", "te", "ti", "to", "va", "ve", "vi")
ENDINGS = {"f": ("na", "la", "ra", "sia"), "m": ("n", "r", "s", "k"), "": ("l", "m", "t", "d")}

_NAME = r"[A-ZÀ-ÞА-ЯΑ-Ω][\w’'-]+"
PATTERN = re.compile(
    "|".join(
        (
            r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))",
            r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
            r"(?:(?<![A-Za-z])(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?(?P<secret>[A-Za-z0-9_/+.=-]{8,}))",
            r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
            r"(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))",
            r"(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))",
            r"(?P<phone>(?<![\d+.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\d-]))",
            r"(?:(?<!\w)(?P<address>" + "|".join(map(re.escape, ADDRESS)) + r") (?P<name>" + _NAME + r"(?: " + _NAME + r"){0,2}))",
        )
    )
)
_DIGIT = re.compile(r"\d")
_BARE = re.compile(r"(?<!\w)" + _NAME)
_SECRET_WORDS = ("token", "secret", "passw", "api", "access")


def may_hold(text: str) -> bool:
    """False only for texts without any entity: plain substring searches, far cheaper than the pattern."""
    if "@" in text or _DIGIT.search(text) or any(a in text for a in ADDRESS):
        return True
    if ":" not in text and "=" not in text:
        return False
    low = text.casefold().replace("ı", "i")  # as (?i:) compares
    return any(w in low for w in _SECRET_WORDS)


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of each entity, in order. A name's type carries its gender."""
    if not may_hold(text):
        return []
    out = []
    for m in PATTERN.finditer(text):
        kind = next(k for k in ("email", "iban", "secret", "ssn", "ip", "card", "phone", "name") if m[k] is not None)
        value = m[kind]
        if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
            continue
        if kind in ("card", "ssn", "phone"):
            form = "".join(str(int(c)) for c in value if c.isdecimal())
        elif kind == "iban":
            form = value.replace(" ", "")
        elif kind in ("email", "name"):
            form = value.lower()
        else:
            form = value
        if not any(c.isalnum() for c in form):
            continue
        out.append((m.start(kind), m.end(kind), f"name:{ADDRESS[m['address']]}" if kind == "name" else kind, form))
    return sorted(out + bare_names(text, out))


def bare_names(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Mentions, outside ``spans``, of the names in them: the whole name or its last word, as written there or in capitals."""
    known: dict[str, tuple[str, str]] = {}
    for start, end, kind, form in spans:
        if kind.startswith("name"):
            name = text[start:end]
            for mention, own in ((name, form), (name.rpartition(" ")[2], form.rpartition(" ")[2])):
                known.setdefault(mention, (kind, own))
                known.setdefault(mention.upper(), (kind, own))
    if not known:
        return []
    out, at = [], 0
    for start, end in [*((a, b) for a, b, _, _ in spans), (len(text), len(text))]:
        words = [(m.start(), m.end()) for m in _BARE.finditer(text, at, start)]
        i = 0
        while i < len(words):
            for k in (3, 2, 1):
                if i + k > len(words) or any(text[words[j][1] : words[j + 1][0]] != " " for j in range(i, i + k - 1)):
                    continue
                mention = text[words[i][0] : words[i + k - 1][1]]
                name = next((x for x in (mention, re.sub("[’'](?:s|S)?$", "", mention)) if x in known), None)
                if name is not None:
                    out.append((words[i][0], words[i][0] + len(name), *known[name]))
                    break
            else:
                k = 1
            i += k
        at = end
    return out


class Draw:
    """A stream of numbers from the key and a label."""

    def __init__(self, key: bytes, *label: object):
        self.key, self.label, self.n, self.bytes = key[:64], "\x1f".join(map(str, label)).encode("utf-8", "replace"), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hashlib.blake2b(self.label + self.n.to_bytes(4, "little"), key=self.key, digest_size=64).digest()
            self.n += 1
        x, self.bytes = int.from_bytes(self.bytes[:4], "little"), self.bytes[4:]
        return x % n


@lru_cache(4096)
def _peers(c: str) -> str:
    """Letters of the same kind and case as ``c``: those of its alphabet, or of its stretch of 64 code points."""
    for low, high in (("a", "z"), ("A", "Z"), ("α", "ρ"), ("Α", "Ρ"), ("а", "я"), ("А", "Я"), ("ぁ", "ん"), ("ァ", "ン")):
        if low <= c <= high:
            return "".join(x for x in map(chr, range(ord(low), ord(high) + 1)) if x.isalpha())
    low = ord(c) & ~63
    return "".join(x for x in map(chr, range(low, low + 64)) if x.isalpha() and x.isupper() == c.isupper() and x.islower() == c.islower()) or c


def _like(c: str, draw: Draw) -> str:
    """A character of the same kind, script and case."""
    if c.isdecimal():
        return chr(ord(c) - int(c) + draw.below(10))
    if c.isalpha():
        return (peers := _peers(c))[draw.below(len(peers))]
    return c


def _alike(text: str, draw: Draw, more: int) -> str:
    """``text`` with like characters, and ``more`` further ones like its last letter or digit."""
    last = next((c for c in reversed(text) if c.isalnum()), "a")
    return "".join(_like(c, draw) for c in text) + "".join(_like(last, draw) for _ in range(more))


def _word(word: str, gender: str, draw: Draw, more: int) -> str:
    """A name of the word's script; Latin ones are built from syllables, with an ending of the gender."""
    if not word[:1] or ord(word[0]) > 0x24F:
        return _alike(word, draw, more)
    return "".join(SYLLABLES[draw.below(len(SYLLABLES))] for _ in range(max(2, (len(word) + 1) // 2) + more)) + ENDINGS[gender][draw.below(len(ENDINGS[gender]))]


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def parts(kind: str, form: str) -> list[tuple[str, str]]:
    """(sort, form) of the parts of an entity that get surrogates of their own, in order."""
    if kind == "email":
        return [("email", form), ("domain", form.rpartition("@")[2])]
    if kind.startswith("name"):
        *first, family = form.split(" ")
        return [*((f"first:{kind.partition(':')[2]}", w) for w in first), ("family", family)]
    return [(kind, form)]


def surrogate(key: bytes, sort: str, form: str, attempt: int = 0) -> str:
    """The canonical form of a part's replacement. From the second new attempt on it has ever more characters, and so ever more room."""
    draw, more = Draw(key, sort.partition(":")[0], form, attempt), max(0, attempt - 1)
    if sort == "email":  # the local part; its domain is a part of its own
        local, _, domain = form.rpartition("@")
        return f"{_alike(local, draw, more)}@{domain}"
    if sort == "domain":
        host, _, top = form.rpartition(".")
        return f"{_alike(host, draw, more)}.{top}"
    if sort == "ip":
        if attempt > 4:  # an address of the block for documentation
            return "2001:db8:" + ":".join(f"{draw.below(65536):x}" for _ in range(6))
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if sort == "card":
        new = form[0] + "".join(str(draw.below(10)) for _ in form[1:] + "0" * more)
        return new if _luhn(form) else new[:-1] + next(d for d in "0123456789" if not _luhn(new[:-1] + d))
    if sort == "phone":
        keep = len(form) - 10 if len(form) > 10 else 0  # the country code stays
        return form[:keep] + "".join(str(draw.below(10)) for _ in form[keep:] + "0" * more)
    if sort == "ssn":
        return "".join(str(draw.below(10)) for _ in form + "0" * more)
    if sort == "iban":
        body = _alike(form[4:], draw, more)
        check = 98 - int("".join(str(int(c, 36)) for c in body + form[:2] + "00")) % 97
        return f"{form[:2]}{check:02d}{body}"
    if sort.startswith("first"):
        return _word(form, sort.partition(":")[2], draw, more)
    if sort == "family":
        return _word(form, "", draw, more)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", form):
        letters = "abcdef" if form.islower() else "ABCDEF"
        return "".join(letters[draw.below(6)] if c.isalpha() else _like(c, draw) for c in form + "0" * more)
    return _alike(form, draw, more)


def _digit_like(c: str, new: str) -> str:
    """``new`` as a digit of the script of ``c``, if both are digits."""
    return chr(ord(c) - int(c) + int(new)) if c.isdecimal() and new.isdecimal() else new


def rendered(kind: str, mention: str, new: str) -> str:
    """``new`` in the format of the mention: separators at their places, letters in its case."""
    if kind in ("card", "ssn", "phone", "iban"):
        fill = iter(new)
        return "".join(_digit_like(c, next(fill, "")) if c.isalnum() else c for c in mention) + "".join(fill)
    if kind == "email":
        local, _, domain = mention.rpartition("@")
        own, _, host = new.rpartition("@")
        cased = lambda x, y: "".join(n.upper() if c.isupper() else n for c, n in zip(x, y)) + (y[len(x) :].upper() if x.isupper() else y[len(x) :])
        return f"{cased(local, own)}@{cased(domain, host)}"
    if kind.startswith("name"):
        return " ".join(w.upper() if m.isupper() and len(m) > 1 else w[:1].upper() + w[1:] for m, w in zip(mention.split(" "), new.split(" ")))
    return new


def whole(key: bytes, kind: str, form: str, again: dict[tuple[str, str], tuple[str, int]]) -> str:
    """The canonical form of an entity's replacement. ``again`` maps parts to the sort and attempt that hold instead of their own and 0."""
    new = []
    for sort, part in parts(kind, form):
        as_sort, attempt = again.get((sort, part), (sort, 0))
        new.append(surrogate(key, as_sort, part, attempt))
    return new[0].rpartition("@")[0] + "@" + new[1] if kind == "email" else " ".join(new)


def replaced(text: str | None, key: bytes, again: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had."""
    spans = found(text) if text else []
    if not spans:
        return text, 0
    out, at = [], 0
    for start, end, kind, form in spans:
        out += [text[at:start], rendered(kind, text[start:end], whole(key, kind, form, again))]
        at = end
    return "".join([*out, text[at:]]), len(spans)


def entities(docs: DataFrame) -> DataFrame:
    """(sort, form): the distinct parts of the entities of ``docs.text``."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen = {x for t in f["text"] if t for _, _, k, v in found(t) for x in parts(k, v)}
            yield pd.DataFrame(sorted(seen), columns=["sort", "form"])

    return docs.select("text").mapInPandas(scan, "sort string, form string").distinct()


def with_gender(known: DataFrame) -> DataFrame:
    """``known(sort, form)`` with ``as_sort``: a first name without gender takes the only gender under which it is known."""
    first = F.col("sort").startswith("first:")
    told = known.where(first & (F.col("sort") != "first:")).groupBy("form").agg(F.min("sort").alias("one"), F.max("sort").alias("other"))
    told = told.where("one = other").select("form", "one", F.lit("first:").alias("sort"))
    joined = known.join(told, ["sort", "form"], "left")
    return joined.select("sort", "form", F.coalesce("one", "sort").alias("as_sort"))


def exceptions(known: DataFrame, key: bytes) -> DataFrame:
    """(sort, form, as_sort, attempt) of those of the distinct parts ``known(sort, form)`` that don't keep their first surrogate.

    All parts are drawn once; what clashes is drawn again against everything drawn before, until nothing does. Each attempt has more room
    than the last, so the few that are left shrink fast.
    """

    @F.pandas_udf("string")
    def drawn(sort: pd.Series, form: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, a) for k, v, a in zip(sort, form, attempt)])

    def space(sort: str) -> Column:
        return F.split(sort, ":")[0]

    sorted_ = written(with_gender(written(known, "entities")), "parts")  # written first: the texts are scanned once
    # one surrogate for each name, however often it stands: under its own sort or one without gender that follows it
    table = sorted_.select(F.col("as_sort").alias("sort"), "form").distinct().withColumn("attempt", F.lit(0)).withColumn("new", drawn("sort", "form", "attempt"))
    table = written(table, "surrogates")
    taken = table.select(space("sort").alias("space"), F.col("form").alias("new")).distinct()
    open_, reserved, done = table, [taken], []
    while True:
        rank = F.row_number().over(Window.partitionBy(space("sort"), "new").orderBy("form", "sort"))
        first = F.first("form").over(Window.partitionBy(space("sort"), "new").orderBy("form", "sort"))
        judged = open_.withColumn("space", space("sort")).withColumn("late", (rank > 1) & (F.col("form") != first))
        used = reserved[0]
        for more in reserved[1:]:
            used = used.unionByName(more)
        judged = judged.join(used.distinct().withColumn("used", F.lit(True)), ["space", "new"], "left")
        judged = written(judged.select("sort", "form", "attempt", "new", "space", (F.col("late") | F.coalesce("used", F.lit(False))).alias("clash")), "surrogates")
        done.append(judged.where("NOT clash AND attempt > 0").select("sort", "form", "attempt"))
        if not judged.where("clash").limit(1).count():
            break
        reserved.append(judged.select("space", "new"))
        open_ = judged.where("clash").select("sort", "form", (F.col("attempt") + 1).alias("attempt")).withColumn("new", drawn("sort", "form", "attempt"))
    moved = done[0]
    for more in done[1:]:
        moved = moved.unionByName(more)
    moved = moved.withColumnRenamed("sort", "as_sort")
    final = sorted_.join(moved, ["as_sort", "form"], "left").select("sort", "form", "as_sort", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return final.where("attempt > 0 OR sort <> as_sort")


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the added column ``n_entities`` (with underscores where there is one already). ``key`` is secret: who knows it can find originals by trial."""
    drawn_again = written(exceptions(entities(docs), key), "exceptions")
    schema = "text string, n_entities int"
    new, digest, again_, count = (unused(docs, x) for x in ("new", "digest", "again", "n_entities"))

    def rows(texts, lists) -> pd.DataFrame:
        return pd.DataFrame([replaced(t, key, a) for t, a in zip(texts, lists)], columns=["text", "n_entities"]).astype({"n_entities": "int32"})

    if drawn_again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = {(r["sort"], r["form"]): (r["as_sort"], r["attempt"]) for r in drawn_again.collect()}

        @F.pandas_udf(schema)
        def act(text: pd.Series) -> pd.DataFrame:
            return rows(text, [again] * len(text))

        done = docs.withColumn(new, act("text"))
    else:  # each text gets the exceptions among its own parts by a join

        @F.pandas_udf("array<struct<sort string, form string>>")
        def own(text: pd.Series) -> pd.Series:
            return pd.Series([[{"sort": k, "form": v} for k, v in {x for _, _, k, v in found(t) for x in parts(k, v)}] if t else [] for t in text])

        @F.pandas_udf(schema)
        def act_on(text: pd.Series, again: pd.Series) -> pd.DataFrame:
            return rows(text, [{(r["sort"], r["form"]): (r["as_sort"], r["attempt"]) for r in a} if a is not None else {} for a in again])

        by_text = docs.select(F.sha2("text", 256).alias(digest), F.explode(own("text")).alias("e")).distinct().select(digest, "e.*")
        lists = by_text.join(drawn_again, ["sort", "form"]).groupBy(digest).agg(F.collect_list(F.struct("sort", "form", "as_sort", "attempt")).alias(again_))
        lists = written(lists, "exceptions-by-text")  # both sides of the join are then plain shuffles, whose heavy keys Spark can split
        done = docs.withColumn(digest, F.sha2("text", 256)).join(lists, digest, "left").withColumn(new, act_on("text", again_))
    text, length = F.col(f"{new}.text"), F.length(f"{new}.text")
    columns = [text.alias("text") if c == "text" else length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*columns, F.col(f"{new}.n_entities").alias(count))


def replacement_report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates and n_entities of each row of ``docs``."""
    return replace_entities(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
