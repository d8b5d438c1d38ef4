"""Personal data: keyed, type-consistent surrogates, in DataFrame functions only.

Entities are found by one pattern, brought to a canonical form so that spellings of one entity corefer, and given
surrogates from HMAC-SHA256 under a secret key. A surrogate that equals a real entity or another's surrogate is drawn
again, so distinct entities stay distinct in the whole corpus.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, others, quoted, stored, table, text_key

#: Key of the registered query and of tests; whoever calls :func:`replace` passes a secret of their own.
TEST_KEY = b"not a secret"
#: Draws after which a format counts as exhausted and is widened.
MAX_DRAWS = 30
#: Characters by which each draw after those widens a format.
WIDER = 4

# Titles that precede a name, by gender, and given names that stand in, by script and gender.
MALE = ("Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа")
NEUTRAL = ("Dr", "Prof", "Доктор")
GIVEN = {
    ("latin", "m"): "adam bruno carl david emil felix georg hugo ivan jonas karl louis martin niko oscar paul robert simon tomas victor".split(),
    ("latin", "f"): "anna berta clara diana emma flora greta hanna irene julia karin laura maria nina olga paula rosa sara tina vera".split(),
    ("latin", "n"): "alex chris dana jamie kim lee morgan noel robin sam".split(),
    ("cyrillic", "m"): "антон борис виктор глеб иван лев михаил олег павел роман".split(),
    ("cyrillic", "f"): "анна вера галина елена ирина лидия мария нина ольга софия".split(),
    ("cyrillic", "n"): "саша женя валя слава".split(),
}
# Letters that stand in for one another: a letter is replaced within its class.
CLASSES = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "äöü", "ÄÖÜ", "áéíóúèêàâçñ", "ÁÉÍÓÚÈÊÀÂÇÑ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", "アイウエオカキクケコサシスセソ", "가나다라마바사아자차카타파하",
)

# Letters outside those classes are replaced by letters of their script: a pattern for a script, and what stands in.
SCRIPTS = {
    r"\p{IsHan}": "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", r"\p{IsHangul}": "가나다라마바사아자차카타파하", r"\p{IsHiragana}": "あいうえおかきくけこさしすせそ", r"\p{IsKatakana}": "アイウエオカキクケコサシスセソ",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsDevanagari}": "अआइउएकखगघचजटडतदनपबमयरलवसह", r"\p{IsThai}": "กขคงจชซดตทนบปพมยรลวส",
    r"\p{IsArmenian}": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփք", r"\p{IsGeorgian}": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    r"[\p{IsCyrillic}&&\p{Lu}]": "БВГДЖЗКЛМНПРСТФХЦЧШЩ", r"\p{IsCyrillic}": "бвгджзклмнпрстфхцчшщ", r"[\p{IsGreek}&&\p{Lu}]": "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", r"\p{IsGreek}": "βγδζθκλμνξπρστφχψ",
    r"\p{Lu}": "ÁÉÍÓÚÈÊÀÂÇÑÄÖÜ", r"\p{L}": "áéíóúèêàâçñäöü", r"\p{N}": "0123456789",
}
# Country calling codes of one and two digits; the others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_TITLE = rf"\b(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\b\.?[ \u00a0]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kind of entity and its pattern, the first that fits whole decides.
KINDS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?i:\b(?:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{8,}",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d.]*\d)",
    "phone": r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}[ .-]?\d{2,4}\b|\+\d{1,3}(?:[ -]?\d{2,4}){2,4}(?![\d.]*\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "card": r"\b\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "person": _TITLE + r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Any text with an entity has one of these; spares the full pattern most texts.
HINT = rf"[0-9@]|{_TITLE}|AKIA|ASIA|(?i:password|passwd|secret|token|api)"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string under a key of at most 64 bytes."""
    if len(key) > 64:
        raise ValueError("a key has at most 64 bytes")
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i`` of a digest in hex, around again after its end."""
    return F.conv(digest.substr((i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def substitute(text: Column, digest: Column) -> Column:
    """Every letter or digit replaced within its class, or else within its script, at the digest's choice; marks stay."""

    def one(c: Column, i: Column) -> Column:
        out = c
        choice = _byte(digest, i) + F.ascii(digest.substr((i % 61) + 1, F.lit(1))) * 7
        pick = lambda letters: F.lit(letters).substr(F.pmod(choice, F.lit(len(letters))) + 1, F.lit(1))
        for script, letters in reversed(SCRIPTS.items()):
            out = F.when(c.rlike(script), pick(letters)).otherwise(out)
        for letters in reversed(CLASSES):
            out = F.when(F.instr(F.lit(letters), c) > 0, pick(letters)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(body: Column) -> Column:
    """Check digit for the digits before it."""
    n = F.length(body)

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.transform(F.split(body, ""), weigh), F.lit(0), lambda a, x: a + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _kind(raw: Column) -> Column:
    return reduce(lambda out, k: F.when(raw.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(out), reversed(list(KINDS)), F.lit("card"))


def _head(raw: Column, kind: Column) -> Column:
    """What of the entity stays: the title of a person, the name of a secret."""
    return F.when(kind == "person", F.regexp_extract(raw, f"^{_TITLE}", 0)).when(kind == "secret", F.regexp_extract(raw, "^.*[=:]\\s*[\"']?", 0)).otherwise("")


def _gender(head: Column) -> Column:
    title = F.regexp_replace(head, r"\.?[ \u00a0]$", "")
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def canonical(raw: Column, kind: Column) -> Column:
    """One form for all spellings of an entity: digits of numbers (after the sign of a country code), lower case of
    addresses and of names with gender."""
    head = _head(raw, kind)
    tail = raw.substr(F.length(head) + 1, F.length(raw))
    return (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(raw, r"\D", ""))
        .when(kind == "phone", F.regexp_replace(raw, r"(?!^\+)\D", ""))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "email", F.lower(raw))
        .when(kind == "person", F.concat_ws("|", _gender(head), F.lower(tail)))
        .otherwise(tail)
    )


def draw(kind: Column, canon: Column, key: bytes, attempt: int) -> Column:
    """A surrogate in canonical form, of the format's width for ``MAX_DRAWS`` attempts and of a wider one after them."""
    wide = min(64, max(0, attempt - MAX_DRAWS + 1) * WIDER)
    digest = hmac_sha256(key, F.concat_ws("\x1f", kind, canon, F.lit(str(attempt))))
    name = F.element_at(F.split(canon, r"\|", 2), -1)
    gender = F.substring(canon, 1, 1)

    def of(digest: Column) -> Column:
        given = F.lit(None).cast("string")
        for (script, g), names in GIVEN.items():
            pick = F.get(F.array(*map(F.lit, names)), F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("int"), F.lit(len(names))))
            given = F.when((gender == g) & (name.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else name.rlike("[a-z]")), pick).otherwise(given)
        words = F.split(name, " ")
        rest = substitute(F.array_join(F.slice(words, 2, F.size(words)), " "), digest)
        person = F.concat(gender, F.lit("|"), F.when((F.size(words) > 1) & given.isNotNull(), F.concat_ws(" ", given, rest)).otherwise(substitute(name, digest)))
        at = F.split(canon, "@")
        host = F.split(F.element_at(at, -1), r"\.")
        email = F.concat(substitute(F.element_at(at, 1), digest), F.lit("@"), substitute(F.element_at(host, 1), F.reverse(digest)), F.lit(".example."), F.element_at(host, -1))
        octets = F.concat_ws(".", *[((_byte(digest, F.lit(k)) % (223 if k == 0 else 256)) + (1 if k == 0 else 0)).cast("string") for k in range(4)])
        body = F.concat(F.substring(canon, 1, 1), substitute(canon.substr(F.lit(2), F.length(canon) - 2), digest))
        card = _let(body, lambda b: F.concat(b, _luhn(b)))
        code = F.when(canon.startswith("+"), F.regexp_extract(canon, COUNTRY, 0)).otherwise(F.substring(canon, 1, 1))
        phone = F.concat(code, substitute(canon.substr(F.length(code) + 1, F.length(canon)), digest))
        first4 = F.concat(F.substring(canon, 1, 4), substitute(canon.substr(F.lit(5), F.length(canon)), digest))
        hexed = F.substring(F.concat(digest, F.sha2(digest, 256), F.sha2(F.reverse(digest), 256)).substr(F.lit(1), F.length(canon)), 1, 192)
        secret = F.when(canon.rlike("^[0-9a-f]{8,192}$"), hexed).otherwise(substitute(canon, digest))
        return (
            F.when(kind == "person", person).when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card)
            .when(kind == "phone", phone).when(kind == "access_key", first4).when(kind == "iban", F.concat(F.substring(canon, 1, 2), substitute(canon.substr(F.lit(3), F.length(canon)), digest)))
            .when(kind == "secret", secret).otherwise(substitute(canon, digest))
        )

    def wider(digest: Column) -> Column:
        """Numbers and keys with more digits; of names, addresses and secrets nothing stays that no draw could change."""
        letters = lambda d, n: F.translate(F.substring(d, 1, n), "0123456789", "ghijklmnop")
        digits = F.translate(F.substring(F.reverse(digest), 1, wide), "abcdef", "024681")
        domain = F.element_at(F.split(canon, r"\."), -1)
        email = F.concat(letters(digest, 4 + wide), F.lit("@"), letters(F.reverse(digest), 8), F.lit(".example."), domain)
        ip = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(digest, 4 * k + 1, 4)) for k in range(6)])
        card = _let(F.concat(F.substring(canon, 1, 1), substitute(canon.substr(F.lit(2), F.length(canon) - 2), digest), digits), lambda b: F.concat(b, _luhn(b)))
        return (
            F.when(kind == "person", F.concat(gender, F.lit("|"), letters(digest, 4 + wide))).when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card)
            .when(kind == "secret", F.substring(digest, 1, 8 + wide)).when(kind == "access_key", F.concat(of(digest), F.upper(letters(digest, wide))))
            .otherwise(F.concat(of(digest), digits))
        )

    return _let(digest, wider if wide else of)


def dressed(raw: Column, kind: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the format of the spelling that it replaces; what a widened one has more follows."""
    place = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    own = F.replace(surrogate, F.lit("+"), F.lit(""))

    def fill(s: Column, c: Column) -> Column:
        takes = c.rlike("^[0-9A-Za-z]$")
        return F.struct(F.concat(s["out"], F.when(takes, own.substr(s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + F.when(takes, 1).otherwise(0)).alias("i"))

    filled = F.aggregate(F.split(raw, ""), place, fill, lambda s: F.concat(s["out"], own.substr(s["i"], F.length(own))))
    head = _head(raw, kind)
    tail = raw.substr(F.length(head) + 1, F.length(raw))
    upper = (tail == F.upper(tail)) & (tail != F.lower(tail))
    name = F.element_at(F.split(surrogate, r"\|", 2), -1)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), filled)
        .when(kind == "person", F.concat(head, F.when(upper, F.upper(name)).otherwise(F.initcap(name))))
        .when(kind == "email", F.when(upper, F.upper(surrogate)).otherwise(surrogate))
        .otherwise(F.concat(head, surrogate))
    )


def entities(docs: DataFrame) -> DataFrame:
    """Occurrences (doc_id, th, pos, raw, kind, canon) in documents that have any.

    A number with the look of a card whose check digit is wrong is of kind ``number``, which stays as it is.
    """
    found = docs.where(F.col("text").rlike(HINT)).select("doc_id", text_key(F.col("text")).alias("th"), F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "raw"))
    kinded = found.withColumn("kind", _kind(F.col("raw")))
    kinded = kinded.withColumn("canon", canonical(F.col("raw"), F.col("kind")))
    card = (F.col("kind") == "card") & (_luhn(F.expr("left(canon, length(canon) - 1)")) != F.expr("right(canon, 1)"))
    return kinded.withColumn("kind", F.when(card, "number").otherwise(F.col("kind")))


def surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) of the distinct entities in occurrences; no two alike, none a real entity's form.

    Each draw keeps, of the entities with one surrogate, the first, unless it is a real form or was taken before; the
    others draw again, from wider formats after ``MAX_DRAWS``, which cannot run out. Joins and sums only; nothing of
    the entities comes to the driver but whether any is left.
    """
    real = checkpointed(found.select("kind", "canon").distinct())
    pending, taken = real, None
    for attempt in count():
        drawn = pending.withColumn("surrogate", draw(F.col("kind"), F.col("canon"), key, attempt))
        free = drawn.join(real.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = checkpointed(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"))
        taken = won if taken is None else taken.unionAll(won)
        pending = checkpointed(pending.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            return taken


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates under ``key`` in ``text``, and ``n_entities``.

    Texts without an entity pass unshuffled; of the others, the occurrences join the surrogates, and the text is put
    together from what stands between them. An entity that a third of the documents hold is a skewed join, which AQE
    splits. Rows that share doc_id and text are one document; null and empty texts have no entities; an empty table
    stays empty. A column n_entities of ``docs``, in any case, is replaced; others may have any name and stay.
    """
    keep = others(docs.columns, ["n_entities"])
    plain_ids = docs.select(F.col("doc_id"), F.col("text"))
    docs = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    found = stored(entities(plain_ids))
    chosen = surrogates(found.where("kind <> 'number'"), key)
    texts = (
        found.distinct().join(chosen, ["kind", "canon"], "left")
        .select("doc_id", "th", F.col("surrogate").isNotNull().alias("is"), F.struct("pos", F.coalesce(dressed(F.col("raw"), F.col("kind"), F.col("surrogate")), "raw").alias("new")).alias("r"))
        .groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("r")).alias("r"), F.count_if("is").alias("n"))
        .select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), F.transform("r", lambda x: x["new"]).alias("new"), "n")
    )
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    named = lambda text: [(text if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(keep)]
    plain = docs.where(~has).select(*named(F.col("text")), F.lit(0).cast("long").alias("n_entities"))
    marked = docs.where(has).withColumn("key", text_key(F.col("text"))).join(texts, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_th")))
    parts = F.zip_with(F.split(F.col("text"), PATTERN, -1), F.col("new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    return plain.unionAll(marked.select(*named(F.array_join(parts, "")), F.col("n").cast("long").alias("n_entities")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data, and how many entities it had.

    Null and empty texts stay as they are; an empty table gives no rows; repeated rows get the same text.
    """
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
