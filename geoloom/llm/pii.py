"""Personal data replaced by keyed surrogates.

Detected entities (mail addresses, phone numbers, card and other long numbers, social security numbers,
IBANs, IP addresses of both versions, secrets, and names of persons) get replacements drawn by a keyed hash
of the entity's normal form, so the same entity has the same surrogate wherever it occurs. A surrogate keeps
type and format: letters stay letters of their case, digits digits, separators stay, a phone keeps its
country code, a card its Luhn check, an IBAN its country and valid check digits, an address its private
range, a name its gender, script, number of parts and case.

A name's parts are replaced one by one, the last as surname, the others as given names. So a person keeps a
surname under any form of address, and where a text has a name, the surname by itself is replaced as well.

Collision check: over the distinct entities of all documents, no two of a type may share a surrogate
and no surrogate may be an entity of the corpus; parts of names count as written, whatever their gender. Those
that lose draw again, until none does. Few draw twice, so documents are rewritten in one pass that draws the first surrogate and knows the
exceptions: sent to the workers if counted to be few, else joined to the documents that have them.

Defined results: a null text stays null and has no entities; an empty one stays empty. Texts without
entities stay byte for byte. Repeated rows each give a row; a null id is returned as it is. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import parts, shared_folder, ship

#: Exceptions that are sent to every worker, at most; more are joined.
MOST_SENT = 10_000
ROUNDS = 30

# Forms of address by gender, given names by script and gender, and parts of surnames.
MALE_TITLES = "Mr Mister Sir Herr Monsieur Señor Sr Signor Господин".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita Sra Signora Госпожа".split()
OTHER_TITLES = "Dr Prof Mx Doktor Professor Доктор".split()
GIVEN = {
    ("latin", "m"): "James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Andrew John Paul Mark Peter George Steven Edward Brian Kevin Henry Frank Hans Klaus Jürgen Stefan Pierre Jacques Philippe Laurent Carlos Miguel Javier Alejandro".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Laura Anna Maria Emma Olga Nancy Sandra Helen Emily Julia Claudia Ursula Sabine Monika Petra Camille Juliette Monique Isabelle Carmen Lucía Dolores Pilar".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Владимир Иван Михаил Николай Павел".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
}
SURNAME = {
    "latin": ("Al Bar Cor Dal El Fen Gar Hol Is Kar Lan Mor Nor Or Pel Ros Sal Tor Ver Wal".split(), "a e i o u ia ea or en an il".split(), "man son ton ford berg well ley wood mann ter sen dale".split()),
    "cyrillic": ("Бел Вол Гор Дан Зим Кал Лаз Мор Нов Пет Род Сав Тих Чер".split(), "а е и о у ор ен ан ил".split(), "ов ев ин ский енко ко".split()),
}

# Ends of made-up given names, and telephone codes of one and two digits.
GIVEN_ENDS = {
    ("latin", "m"): "an on ik er us in ald ert".split(), ("latin", "f"): "a ia ine elle ette ina".split(),
    ("cyrillic", "m"): "ан ор ий ик ел".split(), ("cyrillic", "f"): "а ия ина ья".split(),
}
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_TITLE = {t: g for g, names in (("m", MALE_TITLES), ("f", FEMALE_TITLES), ("x", OTHER_TITLES)) for t in names}
_GENDER = {name.casefold(): g for (_, g), names in GIVEN.items() for name in names}
_NAME = r"[^\W\d_a-zа-яёß-öø-ÿ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_BY = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))

#: Looked for in this order; what one finds the next don't see.
DETECTORS = {
    "secret": re.compile(
        r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_](?:live_|test_)?[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}"
        r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|(?=[a-f]*\d)[0-9a-f]{32,128}|(?=[A-F]*\d)[0-9A-F]{32,128})(?![A-Za-z0-9_])"
        r"|(?i:\b(?:password|passwd|pwd|secret|api[_-]?key|token))\s*[=:]\s*[\"']?([^\s\"'<>]{6,})"
    ),
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"),
    "ip6": re.compile(
        r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,3})?)(?![\w:])"
    ),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"),
    "name": re.compile(
        rf"(?<!\w)(?:({_BY(_TITLE)})\.?[ \t]+({_NAME}(?:[ \t]+{_NAME}){{0,2}})|((?:{_BY([n for names in GIVEN.values() for n in names])})(?:[ \t]+{_NAME}){{1,3}}))(?!\w)"
    ),
}
#: What says of which service a secret is; a surrogate keeps it.
_SECRET_MARK = re.compile(r"(?:AKIA|gh[pousr]_|sk[-_](?:live_|test_)?|xox[abprs]-|eyJ)?")
#: Signs of which a secret without digits has one.
_SECRET_SIGNS = ("=", ":", "_", "AKIA", "sk-", "xox", "eyJ")
#: Kinds that a text without digits can't hold.
_NUMERIC = frozenset(["iban", "ip", "ip6", "ssn", "card", "phone"])



def script_of(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "latin"


def normal_form(kind: str, text: str, gender: str = "") -> str:
    if kind in ("phone", "card", "ssn"):
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind in ("email", "ip6"):
        return text.lower()
    if kind == "name":
        return gender + ":" + " ".join(text.split()).casefold()
    return text


def units(kind: str, normal: str) -> list[tuple[str, str]]:
    """The kinds and normal forms that surrogates are drawn for: a name's parts, else the entity itself."""
    if kind != "name":
        return [(kind, normal)]
    gender, _, words = normal.partition(":")
    *given, last = words.split()
    if not given and last in _GENDER:
        return [("given", f"{_GENDER[last]}:{last}")]
    return [*(("given", f"{gender}:{x}") for x in given), ("name", f":{last}")]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and normal form of each entity, in text order; they don't overlap."""
    out: list[tuple[int, int, str, str]] = []
    some_digit = re.search(r"\d", text) is not None
    for kind, pattern in DETECTORS.items():
        if kind in _NUMERIC and not some_digit or kind == "email" and "@" not in text or kind == "secret" and not (some_digit or any(x in text for x in _SECRET_SIGNS)):
            continue
        for m in pattern.finditer(text):
            gender = ""
            span = m.span()
            if kind == "secret" and m[1]:
                span = m.span(1)
            if kind == "name":
                span = m.span(2) if m[1] else m.span(3)
                given = text[span[0] : span[1]].split()[0].casefold()
                gender = _GENDER.get(given) or (_TITLE[m[1]] if m[1] else "x")
            new = (*span, kind, normal_form(kind, text[span[0] : span[1]], gender))
            at = bisect(out, new)
            if (not at or out[at - 1][1] <= span[0]) and (at == len(out) or span[1] <= out[at][0]):
                out.insert(at, new)
    # Surnames that the text has by themselves.
    surnames = {text[x:y].split()[-1] for x, y, kind, normal in out if kind == "name" and units(kind, normal)[-1][0] == "name"}
    if surnames:
        for m in re.finditer(rf"(?<![\w@.-])(?:{_BY(surnames)})(?![\w@])", text):
            new = (*m.span(), "name", normal_form("name", m[0]))
            at = bisect(out, new)
            if (not at or out[at - 1][1] <= m.start()) and (at == len(out) or m.end() <= out[at][0]):
                out.insert(at, new)
    return out


class Draw:
    """Numbers from a keyed hash, as many as needed."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.turn, self.pool = key, "\0".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.what + self.turn.to_bytes(4, "big"), hashlib.sha256).digest()
            self.turn += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n

    def like(self, text: str) -> str:
        """Letters of the same case and digits for the text's; a hexadecimal text stays one."""
        letters = "abcdef" if re.fullmatch(r"[0-9a-fA-F]{16,}", text) else "abcdefghijklmnopqrstuvwxyz"
        out = []
        for c in text:
            if c.isdecimal():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = letters[self.below(len(letters))]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def surrogate(kind: str, normal: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate's normal form; of a name's part for the kinds given and name."""
    # A part of a name is drawn without its gender, so that it is the same under any form of address.
    draw = Draw(key, kind, normal.partition(":")[2] if kind == "name" else normal, str(attempt))
    if kind == "email":
        local, _, domain = normal.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{draw.like(local)}@{Draw(key, 'domain', host).like(host)}.{top}"
    if kind == "phone":
        code = next((n + 1 for n in (1, 2) if normal[1 : n + 1] in CODES), 4) if normal.startswith("+") else 0
        return normal[:code] + draw.like(normal[code:])
    if kind == "card":
        body = normal[0] + draw.like(normal[1:-1])
        check = -_luhn(body + "0") % 10
        return body + str(check if _luhn(normal) == 0 else (check + 1 + draw.below(9)) % 10)
    if kind == "iban":
        body = draw.like(normal[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + normal[:2] + "00")) % 97
        return f"{normal[:2]}{check:02d}{body}"
    if kind == "ip6":
        # The first group, which tells the range, stays.
        first, *rest = normal.split(":")
        return ":".join([first, *("".join("0123456789abcdef"[draw.below(16)] for _ in g) for g in rest)])
    if kind == "ip":
        a, b, *_ = old = [int(x) for x in normal.split(".")]
        held = 1 if a in (10, 127) else 2 if (a, b) == (192, 168) or a == 172 and 16 <= b < 32 else 0
        new = [1 + draw.below(223) if not held else a, draw.below(256), draw.below(256), 1 + draw.below(254)]
        while not held and (new[0] in (10, 127, 172, 192)):
            new[0] = 1 + draw.below(223)
        return ".".join(map(str, old[:held] + new[held:]))
    if kind in ("given", "name"):
        gender, _, word = normal.partition(":")
        script = script_of(word)
        begin, middle, end = SURNAME[script]

        def made(last: list[str]) -> str:
            return begin[draw.below(len(begin))] + "".join(middle[draw.below(len(middle))] + "lrnmvst"[draw.below(7)] * (script == "latin") for _ in range(1 + draw.below(3))) + last[draw.below(len(last))]

        if kind == "name":
            return gender + ":" + made(end).casefold()
        own = gender if gender in ("m", "f") else "mf"[draw.below(2)]
        names = GIVEN[script, own]
        return gender + ":" + (names[draw.below(len(names))] if not attempt else made(GIVEN_ENDS[script, own])).casefold()
    if kind == "secret":
        mark = _SECRET_MARK.match(normal)
        return normal[: mark.end()] + draw.like(normal[mark.end() :])
    return draw.like(normal)


def rendered(kind: str, normal: str, seen: str) -> str:
    """A surrogate's normal form in the format of the occurrence that it replaces."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(normal.lstrip("+") if kind != "iban" else normal)
        return "".join(next(signs) if c.isalnum() else c for c in seen)
    if kind in ("email", "ip6"):
        return normal.upper() if seen.isupper() else normal
    if kind == "name":
        new = normal.partition(":")[2].split()
        old = re.split(r"([ \t]+)", seen)
        cased = [w.upper() if o.isupper() and len(o) > 1 else w.capitalize() for w, o in zip(new, old[::2], strict=True)]
        return "".join(x for pair in zip(cased, [*old[1::2], ""], strict=True) for x in pair)
    return normal


def replace(text: str, key: bytes, exceptions: dict[tuple[str, str], str]) -> tuple[str, int]:
    """The text with surrogates, and how many entities were replaced."""
    found = detect(text)
    out, at = [], 0
    for start, end, kind, normal in found:
        new = [exceptions.get(x) or surrogate(*x, key) for x in units(kind, normal)]
        new = ":" + " ".join(x.partition(":")[2] for x in new) if kind == "name" else new[0]
        out += [text[at:start], rendered(kind, new, text[start:end])]
        at = end
    return "".join([*out, text[at:]]), len(found)


def entities(docs: DataFrame) -> DataFrame:
    """id, row, kind, normal of the units of the entities of docs (id, row, text); each once for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                place, kinds, normals = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    for kind, normal in dict.fromkeys(x for e in detect(text or "") for x in units(e[2], e[3])):
                        place.append(k)
                        kinds.append(kind)
                        normals.append(normal)
                at = pa.array(place, pa.int64())
                yield pa.record_batch([part.column("id").take(at), part.column("row").take(at), pa.array(kinds, pa.string()), pa.array(normals, pa.string())], names=["id", "row", "kind", "normal"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "row", "text").mapInArrow(run, f"id {kind}, row bigint, kind string, normal string")


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """rows (kind, normal, attempt) with their surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, n, key, a) for k, n, a in zip(*(batch.column(c).to_pylist() for c in ("kind", "normal", "attempt")), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("kind", "normal", "attempt")), pa.array(new, pa.string())], names=["kind", "normal", "attempt", "surrogate"])

    return rows.select("kind", "normal", "attempt").mapInArrow(run, "kind string, normal string, attempt int, surrogate string")


def assign(distinct: DataFrame, key: bytes, draw=_drawn) -> DataFrame:
    """kind, normal, attempt, surrogate of distinct entities (kind, normal), after the collision checks."""
    shared_folder(distinct.sparkSession)
    # Parts of names are compared as they are written, without their gender.
    written = lambda c: F.when(F.col("kind").isin("name", "given"), F.regexp_replace(c, "^[mfx]?:", "")).otherwise(F.col(c)).alias("_written")
    now = draw(distinct.withColumn("attempt", F.lit(0)), key).checkpoint()
    settled = None
    for _ in range(ROUNDS):
        # Earlier attempts keep their surrogate; of one attempt, the smallest entity does.
        owner = now.groupBy("kind", written("surrogate")).agg(F.min(F.struct("attempt", "normal")).alias("_own"))
        real = now.select("kind", written("normal")).distinct().withColumn("_real", F.lit(True))
        judged = now.withColumn("_written", written("surrogate")).join(owner, ["kind", "_written"]).join(real, ["kind", "_written"], "left")
        judged = judged.withColumn("_lost", F.col("_real").isNotNull() | (F.col("_own.normal") != F.col("normal"))).checkpoint()
        lost = judged.where("_lost")
        if lost.isEmpty():
            return now
        settled = judged.where("not _lost").select("kind", "normal", "attempt", "surrogate")
        again = draw(lost.select("kind", "normal", (F.col("attempt") + 1).alias("attempt")), key)
        now = settled.unionByName(again).checkpoint()
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT, draw=_drawn) -> DataFrame:
    """id, text (with surrogates) and n_entities of every row."""
    spark = shared_folder(ship(docs.sparkSession))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    found = entities(rows)
    changed = assign(found.select("kind", "normal").distinct(), key, draw).where("attempt > 0").select("kind", "normal", "surrogate")
    few = changed.limit(most_sent + 1).collect()
    sent: dict[tuple[str, str], str] = {}
    if len(few) <= most_sent:
        sent = {(r.kind, r.normal): r.surrogate for r in few}
        rows = rows.withColumn("own", F.lit(None).cast("array<struct<kind:string,normal:string,surrogate:string>>"))
    else:
        own = found.join(changed, ["kind", "normal"]).groupBy("id", "row").agg(F.collect_list(F.struct("kind", "normal", "surrogate")).alias("own"))
        own = own.withColumnRenamed("id", "_id").withColumnRenamed("row", "_row")
        rows = rows.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    known = spark.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                out = []
                for text, own in zip(part.column("text").to_pylist(), part.column("own").to_pylist(), strict=True):
                    exceptions = {(x["kind"], x["normal"]): x["surrogate"] for x in own} if own else known.value
                    out.append((None, 0) if text is None else replace(text, key, exceptions))
                yield pa.record_batch([part.column("id"), pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["id", "text", "n_entities"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("id", "text", "own").mapInArrow(run, f"id {kind}, text string, n_entities bigint")
