"""Personal data replaced by keyed surrogates.

Detected entities are brought to a canonical form, and a keyed function of kind and form gives the
surrogate, so an entity is the same surrogate in every document. Kinds with a format (addresses,
numbers, secrets) go through a keyed permutation of all strings of that format: two entities of one format
cannot meet, and letters stay letters of their alphabet and case, digits digits. Card and account numbers
are those whose check digits are right, and so are their surrogates; an account keeps its country.

A name begins after a title, and its words are entities of their own; the document's other mentions of
them, without a title, are the same entities. A name's gender is what its titles say over the whole corpus
(none if they differ or say nothing), so its surrogate does not change with the title. It comes from a large keyed
pool of its gender and script; a script without a pool keeps its letters' block instead.

Collision checks then run over the corpus's distinct entities, as joins: a surrogate that two entities
share, or that is itself an entity of the corpus, is drawn again with the next attempt until none is
left, whatever its length. Only the redrawn ones are exceptions to the function. The name pool grows with the number of names, so they
are few; up to a bound tasks hold them, beyond it they are joined to the documents by entity. Only then are
texts shuffled. Where a format is so full that RETRIES attempts all gave an entity of the corpus, a name of a script without
a pool becomes longer, by a letter with every further attempt, and anything else becomes a marked placeholder, such as
<phone 9f86d081884c7d65>, which no entity can be. So no real entity is ever a surrogate.

Defined results: null stays null; a text without entities stays as it is; every input row gives one row, by
its own text, also where ids repeat; texts are read whole, however long; names without any title in their
document are not found; other columns stay, and those named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, extend, fresh_name, ship, written

#: The most redrawn entities that tasks are handed; beyond it they are joined.
MAX_REDRAWN = 200_000
#: Attempts at a surrogate of the entity's own format that is no entity of the corpus.
RETRIES = 24
#: Alphabets whose letters are replaced among themselves.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "ÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝŸ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
HEX = re.compile(r"[0-9a-f]+").fullmatch
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
#: Titles with the gender they tell, and the syllables of the name pools by script.
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "n", "Prof": "n"}
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе бо да де ди до га го ка ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви".split(),
    "greek": "βα βε βι γα γε γι δα δε δι ζα ζε ζι θα θε θι κα κε κι λα λε λι μα με μι να νε νι πα πε πι ρα ρε ρι σα σε σι τα τε τι φα φε φι".split(),
}
ENDINGS = {("latin", "m"): "nd", ("latin", "f"): "na", ("latin", "n"): "r", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("cyrillic", "n"): "р", ("greek", "m"): "ος", ("greek", "f"): "α", ("greek", "n"): "ης"}

EMAIL = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")
NUMBER = re.compile(r"\+?\(?\d[\d .()/-]{5,}\d")
IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}")
CARD = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{13,19}|\d{4}[ -]?\d{6}[ -]?\d{5}")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
SECRET = re.compile(r"(?i)\b(?:passwor[dt]|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_+/=.-]{6,})")
CLOUD_KEY = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{12,}\b")
TITLE = re.compile(r"\b(" + "|".join(TITLES) + r")\.?[ \u00a0]")
NAME_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*")
INITIAL = re.compile(r"[^\W\d_]\. ?")
TITLE_HINTS = tuple(f"{t}{end}" for t in TITLES for end in (". ", " "))


@cache
def alphabet_of(c: str) -> str | None:
    """The letters (or digits) that may stand for c; None for marks. Outside ALPHABETS: those of its category in a block around it."""
    if c in ALPHABET_OF or not c.isalnum():
        return ALPHABET_OF.get(c)
    kind = unicodedata.category(c)
    for bits in (8, 12, 16):
        low = ord(c) >> bits << bits
        near = "".join(x for x in map(chr, range(low, low + (1 << bits))) if unicodedata.category(x) == kind and x.isalnum() and x not in ALPHABET_OF)
        if len(near) >= 10:
            break
    return near


def luhn(digits: str) -> int:
    """The check digit after these digits."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_check(country: str, body: str) -> int:
    """The two check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


@cache
def script_of(c: str) -> str:
    return unicodedata.name(c, "other").split(" ")[0].lower()


def names(text: str) -> list[tuple[int, int, str, str]]:
    """The words of titled names, at most three a title, and every other mention of those words."""
    out, kinds = [], {}
    for m in TITLE.finditer(text):
        at = m.end()
        for _ in range(3):
            while i := INITIAL.match(text, at):
                at = i.end()
            w = NAME_WORD.match(text, at)
            word = re.sub("['’]s$", "", w[0]) if w else ""
            if len(word) < 2 or word[0].islower():
                break
            kind = f"name {TITLES[m[1]]} {script_of(word[0])}"
            out.append((at, at + len(word), kind, word.lower()))
            kinds.setdefault(word, kind)
            at += len(word)
            if text[at : at + 1] not in (" ", "-"):
                break
            at += 1
    if kinds:
        for k in [k for k in kinds if k.upper() not in kinds]:
            kinds[k.upper()] = kinds[k]
        words = sorted((k for k in kinds if script_of(k[0]) != "cjk"), key=lambda k: (-len(k), k))
        unspaced = sorted((k for k in kinds if script_of(k[0]) == "cjk"), key=lambda k: (-len(k), k))
        forms = [rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)"] * bool(words) + list(map(re.escape, unspaced))
        out += [(m.start(), m.end(), kinds[m[0]], m[0].lower()) for m in re.finditer("|".join(forms), text)]
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), apart from each other, in order."""
    out: list[tuple[int, int, str, str]] = []
    if "@" in text:
        out += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(1), m.end(1), "secret", m[1]) for m in SECRET.finditer(text)]
    if "KIA" in text or "SIA" in text:
        out += [(m.start(), m.end(), "secret", m[0]) for m in CLOUD_KEY.finditer(text)]
    runs = list(NUMBER.finditer(text))
    for run in runs:
        at = run.start()
        while at < run.end():
            for kind, rx in (("phone", PHONE), ("ssn", SSN), ("ip", IP), ("card", CARD)):
                m = rx.match(text, at, run.end())
                if not m or text[m.end() : m.end() + 1].isdigit() or text[m.start() - 1 : m.start()].isalnum() and m.start():
                    continue
                form = re.sub(r"\D", "", m[0])
                if kind == "ip":
                    if any(int(x) > 255 or x != str(int(x)) for x in m[0].split(".")):
                        continue
                    form = m[0]
                elif kind == "card" and int(form[-1]) != luhn(form[:-1]):
                    continue
                out.append((m.start(), m.end(), kind, form))
                at = m.end() - 1
                break
            at += 1
    if runs:
        accounts = [(m, m[0].replace(" ", "")) for m in IBAN.finditer(text)]
        out += [(m.start(), m.end(), "iban", f) for m, f in accounts if 15 <= len(f) <= 34 and int(f[2:4]) == iban_check(f[:2], f[4:])]
    if any(h in text for h in TITLE_HINTS):
        out += names(text)
    kept, last = [], 0
    for e in sorted(out, key=lambda e: (e[0], -e[1])):
        if e[0] >= last:
            kept.append(e)
            last = e[1]
    return [e for e in kept if e[2] not in ("secret", "email") or any(c.isalnum() for c in (e[3].rpartition(".")[0] if e[2] == "email" else e[3]))]


def permuted(n: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a Feistel network, walked until it is back in range."""
    bits = max(2, (size - 1).bit_length())
    low = bits // 2
    while True:
        a, b, na, nb = n >> low, n & ((1 << low) - 1), bits - low, low
        for r in range(8):
            f = hashlib.blake2b(f"{r} {tweak} {b}".encode(), key=key, digest_size=32).digest()
            a, b, na, nb = b, (a ^ int.from_bytes(f, "big")) & ((1 << na) - 1) if na <= 256 else a, nb, na
        n = a << nb | b
        low = nb if nb == bits // 2 else bits // 2
        if n < size:
            return n


def in_format(form: str, key: bytes, tweak: str) -> str:
    """The string of the same format (alphabet by place, other characters kept) that the permutation gives."""
    as_hex = tweak.startswith("secret") and HEX(form)
    alphabets = ["0123456789abcdef" if as_hex else alphabet_of(c) for c in form]
    n, size = 0, 1
    for c, a in zip(form, alphabets, strict=True):
        if a:
            n, size = n * len(a) + a.index(c), size * len(a)
    if size == 1:
        return form
    mask = f"hex {len(form)}" if as_hex else "".join((str(ALPHABETS.index(a)) if a in ALPHABETS else f"<{ord(a[0]):x} {len(a)}>") if a else c for c, a in zip(form, alphabets, strict=True))
    n = permuted(n, size, key, f"{tweak} {mask}")
    out = []
    for c, a in zip(reversed(form), reversed(alphabets), strict=True):
        if a:
            n, i = divmod(n, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def surrogate(kind: str, form: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the replacement."""
    tweak = f"{kind} {attempt}"
    if attempt >= RETRIES and not (kind.startswith("name") and kind.split(" ")[2] in SYLLABLES):
        if not kind.startswith("name"):
            return f"<{kind} {hashlib.blake2b(f'{tweak} {form}'.encode(), key=key, digest_size=8).hexdigest()}>"
        letters = [c for c in form if alphabet_of(c)] or ["x"]
        more = attempt - RETRIES + 1
        form += "".join(letters[i % len(letters)] for i in range(more))
    if kind == "card":
        body = form[0] + in_format(form[1:-1], key, tweak)
        return body + str(luhn(body))
    if kind == "iban":
        body = in_format(form[4:], key, f"{tweak} {form[:2]}")
        return f"{form[:2]}{iban_check(form[:2], body):02d}{body}"
    if kind == "phone":
        keep = 1 if form[0] == "1" or len(form) > 10 else 0
        return form[:keep] + in_format(form[keep:], key, tweak)
    if kind == "ip":
        spans = [(0, 10), (10, 90), (100, 156)]
        parts = [(int(x), *spans[len(x) - 1]) for x in form.split(".")]
        n, size = 0, 1
        for x, low, count in parts:
            n, size = n * count + x - low, size * count
        n = permuted(n, size, key, tweak + str([p[1] for p in parts]))
        out = []
        for _, low, count in reversed(parts):
            n, i = divmod(n, count)
            out.append(str(low + i))
        return ".".join(reversed(out))
    if kind == "email":
        body, dot, suffix = form.rpartition(".")
        return in_format(body, key, f"{tweak} {suffix}") + dot + suffix
    if kind == "secret" and form[:4] in ("AKIA", "ASIA"):
        return form[:4] + in_format(form[4:], key, tweak)
    if kind.startswith("name"):
        _, gender, script = kind.split(" ")
        if script not in SYLLABLES:
            return in_format(form, key, tweak)
        n = int.from_bytes(hashlib.blake2b(f"{tweak} {form}".encode(), key=key, digest_size=16).digest(), "big")
        pool, out = SYLLABLES[script], ""
        for _ in range(3 + attempt // 4):
            n, i = divmod(n, len(pool))
            out += pool[i]
        return out + ENDINGS[script, gender]
    return in_format(form, key, tweak)


def render(original: str, kind: str, form: str) -> str:
    """The surrogate in the original's spelling: its case, spaces and marks. A placeholder stands as it is."""
    if form.startswith("<"):
        return form
    if kind.startswith("name"):
        return form.upper() if original.isupper() and len(original) > 1 else form[:1].upper() + form[1:]
    if kind == "ip" or kind == "secret":
        return form
    chars = iter([c for c in form if c.isalnum()] if kind not in ("email",) else list(form))
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, form, strict=True))
    return "".join(next(chars) if c.isalnum() else c for c in original)


def _key(key: str, epoch: int) -> bytes:
    return hashlib.blake2b(f"{epoch} {key}".encode(), digest_size=32).digest()


def group_of(kind: Column) -> Column:
    """What entities are told apart in: the kind, for names without the gender."""
    return F.when(kind.startswith("name "), F.concat(F.lit("name "), F.element_at(F.split(kind, " "), 3))).otherwise(kind)


def found_entities(docs: DataFrame, text_col: str) -> DataFrame:
    """said, form: the corpus's distinct entities, names with the gender that a title says."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            got = {e[2:] for at in range(0, b.num_rows, SLICE) for t in b.column(0).slice(at, SLICE).to_pylist() if t for e in entities(t)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([f for _, f in got], pa.string())], names=["said", "form"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "said string, form string").distinct()


def resolved(found: DataFrame) -> DataFrame:
    """kind, form: each entity once, names with the gender that holds in the whole corpus."""
    said = F.when(F.col("said").startswith("name "), F.element_at(F.split("said", " "), 2))
    rows = found.groupBy(group_of(F.col("said")).alias("grp"), "form").agg(F.max(said == "m").alias("m"), F.max(said == "f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    kind = F.when(F.col("grp").startswith("name "), F.concat(F.lit("name "), gender, F.lit(" "), F.element_at(F.split("grp", " "), 2))).otherwise(F.col("grp"))
    return rows.select(kind.alias("kind"), "form")


def first_attempts(known: DataFrame) -> dict[str, int]:
    """The attempt that names of a kind begin with: one whose pool holds ten times as many."""
    out = {}
    for r in known.where("kind LIKE 'name %'").groupBy("kind").count().collect():  # a row a gender and script
        pool, size = len(SYLLABLES.get(r["kind"].split(" ")[2], ())), 3
        while pool > 1 and pool**size < 10 * r["count"]:
            size += 1
        out[r["kind"]] = 4 * (size - 3)
    return out


def drawn(known: DataFrame, key: str, first: dict[str, int]) -> DataFrame:
    """kind, form, base, attempt, sur of every entity, without collisions; base is the kind's first attempt."""
    shape = "kind string, form string, base int, attempt int, sur string"
    secret = _key(key, 0)

    def draw(batches: Iterator) -> Iterator:
        for b in batches:
            kinds, forms, attempts = (b.column(c).to_pylist() for c in ("kind", "form", "attempt"))
            new = [surrogate(k, f, secret, a) for k, f, a in zip(kinds, forms, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "sur"])

    base = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in first.items()], F.lit(0)).cast("int")
    rows = written(known.select("kind", "form", base.alias("base"), base.alias("attempt")).mapInArrow(draw, shape), "drawn")
    while True:
        # of entities with one surrogate the first keeps it, and none may keep what is an entity itself
        owners = rows.groupBy(group_of(F.col("kind")).alias("grp"), "sur").agg(F.min(F.struct("attempt", "form")).alias("first"), F.count("*").alias("n")).where("n > 1").select("grp", "sur", F.col("first.form").alias("owner"))
        real = known.select(group_of(F.col("kind")).alias("grp"), F.col("form").alias("sur"), F.lit(True).alias("real"))
        judged = rows.withColumn("grp", group_of(F.col("kind"))).join(owners, ["grp", "sur"], "left").join(real, ["grp", "sur"], "left")
        is_real = F.coalesce("real", F.lit(False))
        bad = judged.where(is_real | (F.col("owner") != F.col("form"))).select("kind", "form", "base", (F.col("attempt") + 1).alias("attempt"))
        bad = written(bad, "collided")
        if bad.isEmpty():
            return rows
        rows = written(rows.join(bad.select("kind", "form"), ["kind", "form"], "left_anti").union(bad.mapInArrow(draw, shape)), "drawn")


def with_attempts(docs: DataFrame, again: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds the document's exceptional entities as an array of (said, form, kind, attempt)."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            got = []
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                got += [(i, *e) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for e in {e[2:] for e in entities(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], x) for j, x in enumerate((pa.int64(), pa.string(), pa.string()))], names=["row", "said", "form"])

    row = fresh_name(docs, "__row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    held = docs.select(row, F.col(text_col).cast("string")).mapInArrow(run, "row long, said string, form string")
    lists = held.join(again, ["said", "form"]).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("said", "form", "kind", "attempt")).alias(name))
    return docs.join(lists, row, "left").drop(row)


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", max_redrawn: int = MAX_REDRAWN) -> DataFrame:
    """The input columns, with surrogates in text_col, and n_entities (long)."""
    ship(docs.sparkSession)
    found = written(found_entities(docs, text_col), "said")
    known = written(resolved(found), "entities")
    first = first_attempts(known)
    drawn_rows = drawn(known, key, first)
    # the exceptions: entities drawn again, and names that a document gives another gender than the corpus
    named = drawn_rows.select(group_of(F.col("kind")).alias("grp"), "form", "kind", "base", "attempt")
    table = found.withColumn("grp", group_of(F.col("said"))).join(named, ["grp", "form"]).where("attempt > base OR said <> kind").select("said", "form", "kind", "attempt")
    table = written(table, "exceptions")
    few = table.count() <= max_redrawn
    again = {(r["said"], r["form"]): (r["kind"], r["attempt"]) for r in table.collect()} if few else {}
    secret = _key(key, 0)
    columns = [c for c in docs.columns if c != "n_entities"]
    source = docs.select(*columns)
    more, new = fresh_name(source, "__more"), fresh_name(source, "__new")
    source = source.withColumn(more, F.lit(None).cast("array<struct<said:string,form:string,kind:string,attempt:int>>")) if few else with_attempts(source, table, text_col, more)

    def run(rows: pa.StructArray) -> list:
        texts, counts, held = [], [], {}
        for text, extra in zip(rows.field(0).to_pylist(), rows.field(1).to_pylist(), strict=True):
            got = entities(text) if text else []
            for x in extra or ():
                held[x["said"], x["form"]] = surrogate(x["kind"], x["form"], secret, x["attempt"])
            parts, at = [], 0
            for start, end, said, form in got:
                if (said, form) not in held:
                    kind, attempt = again.get((said, form), (said, first.get(said, 0)))
                    held[said, form] = surrogate(kind, form, secret, attempt)
                parts += (text[at:start], render(text[start:end], said, held[said, form]))
                at = end
            texts.append("".join([*parts, text[at:]]) if got else text)
            counts.append(len(got))
        return [pa.array(texts, pa.string()), pa.array(counts, pa.int64())]

    out = extend(source, F.struct(F.col(text_col).cast("string").alias("t"), F.col(more).alias("m")), run, f"`{new}` string, n_entities long")
    return out.select(*[F.col(new).alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "n_entities"], "n_entities")
