"""Surrogates for personal data, with DataFrame functions only.

Entities are found by patterns, brought to a canonical form and given a keyed surrogate of their
type: letters stay letters, digits digits, separators stay where they were, names keep gender and
script, card numbers keep their check-digit property.  One table holds each distinct entity once,
so all mentions of an entity get the same surrogate; surrogates that meet, or that equal an entity
that occurs, are drawn again until all differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Господин", "Г-н", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Г-жа", "Κυρία"]
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE, key=len, reverse=True)) + r")\.?"
#: Type -> pattern, tried in this order.
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[0-9]*[a-f])[0-9a-f]{24,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}"
              r"|sk-[0-9A-Za-z]{20,})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){2,7}(?: ?[0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}]){TITLE} \p{{Lu}}[\p{{L}}’'-]+(?: \p{{Lu}}[\p{{L}}’'-]+){{0,2}}",
}
# the back reference of "card" counts groups from the start of the whole pattern
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: Something that every entity has; most texts have none of it and are not searched further.
CUE = r"[0-9@]|(?:" + "|".join(MALE + FEMALE) + r")[. ]"

GIVEN = {
    ("m", "latin"): "Adam Bruno Conrad David Emil Felix Gustav Hugo Ivan Julian Leon Martin Nils Oscar Paul Victor".split(),
    ("f", "latin"): "Anna Bianca Clara Diana Elena Flora Greta Helena Irene Julia Laura Marta Nora Olivia Paula Vera".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Юрий".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Софья Юлия".split(),
    ("m", "greek"): "Αλέξης Βασίλης Γιάννης Δημήτρης Ηλίας Θανάσης Κώστας Λάμπρος Μάριος Νίκος Ορέστης Πέτρος Σπύρος Στέλιος Τάσος Φώτης".split(),
    ("f", "greek"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θεοδώρα Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Όλγα Σοφία Φωτεινή".split(),
}
SYLLABLES = {
    "latin": "bal cor den fer gol han jor kel lim mar nev pol rin sol tav wen".split(),
    "cyrillic": "бал вор ген дар жил зор кам лев мир нов пол рад сол тим фед шан".split(),
    "greek": "βαλ γορ δεν ζακ καλ λιμ μαρ νεφ παλ ριν σολ ταρ φερ χαν ψιλ κορ".split(),
}


def kind_of(mention):
    out = F.lit(None).cast("string")
    for name, p in reversed(TYPES.items()):
        out = F.when(mention.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind, mention):
    name = F.regexp_replace(mention, rf"^{TITLE} ", "")
    gender = F.when(mention.rlike("^(?:" + "|".join(FEMALE) + r")\.? "), F.lit("f")).otherwise(F.lit("m"))
    return (F.when(kind == "email", F.lower(mention))
            .when(kind.isin("iban", "card", "ssn", "phone"), F.regexp_replace(mention, r"[^0-9A-Za-z+]", ""))
            .when(kind == "person", F.concat(gender, F.lit(":"), F.lower(name)))
            .otherwise(mention))


def _shaped(text, hex_, letters: str):
    """Each digit and letter of ``text`` replaced by one drawn from the hex digits, in kind."""
    digits = F.translate(hex_, "abcdef", "012345")
    lower = F.translate(hex_, "0123456789abcdef", letters)
    n = F.length(hex_)
    at = lambda s, i: F.substr(s, (i % n) + 1, F.lit(1))
    one = lambda c, i: (F.when(c.rlike("[0-9]"), at(digits, i)).when(c.rlike(r"\p{Lu}"), F.upper(at(lower, i)))
                        .when(c.rlike(r"\p{L}"), at(lower, i)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits):
    """Sum of the check-digit rule over a string of digits."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when(
            (n - i) % 2 == 0, (c.cast("int") * 2) - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0)))
            .otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)


def surrogate(kind, canon, attempt, key: str):
    """The surrogate, in canonical form, that an entity gets at the given attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    hex_ = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))
    pick = lambda at, n: F.conv(F.substring(hex_, at, 4), 16, 10).cast("int") % n
    local = F.substring_index(canon, "@", 1)
    long_local = F.rpad(local, F.greatest(F.length(local), F.lit(8)).cast("int"), F.lit("x"))
    domain = F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.substring_index(canon, "@", -1)), 256), 1, 6),
                         "0123456789abcdef", "bcdfghklmnprstvw")
    email = F.concat(_shaped(long_local, hex_, "abcdefghiklmnopr"), F.lit("@"), domain, F.lit(".example.com"))
    card = F.concat(F.substring(canon, 1, 1), F.substring(F.translate(hex_, "abcdef", "012345"), 1, F.lit(200)))
    body = F.substr(card, F.lit(1), F.length(canon) - 1)
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    valid = _luhn(canon) % 10 == 0
    card = F.concat(body, F.when(valid, check).otherwise((check + 1 + pick(100, 9)) % 10).cast("string"))
    ip = F.concat_ws(".", (pick(1, 16) + 240).cast("string"), *[pick(n, 256).cast("string") for n in (5, 9, 13)])
    phone = F.concat(F.substring(canon, 1, 2), _shaped(F.substr(canon, F.lit(3)), hex_, "abcdefghiklmnopr"))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), F.lit("greek")) \
        .otherwise(F.lit("latin"))
    person = F.lit(None).cast("string")
    words = F.size(F.split(canon, " "))
    for (gender, alphabet), names in GIVEN.items():
        word = lambda options, at: F.element_at(F.array(*[F.lit(o) for o in options]), pick(at, len(options)) + 1)
        last = F.concat(*[word(SYLLABLES[alphabet], 20 + 4 * j) for j in range(5)])
        full = F.concat(F.lit(gender + ":"), F.when(words > 1, F.concat(F.lower(word(names, 1)), F.lit(" "))).otherwise(F.lit("")), last)
        person = F.when((F.substring(canon, 1, 1) == gender) & (script == alphabet), full).otherwise(person)
    found = (F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "phone", phone)
             .when(kind == "person", person)
             .when(kind == "secret", F.when(canon.rlike("^[0-9a-f]+$"), _shaped(canon, hex_, "abcdefabcdefabcd"))
                   .otherwise(F.concat(F.substring(canon, 1, 4), _shaped(F.substr(canon, F.lit(5)), hex_, "abcdefghiklmnopr"))))
             .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _shaped(F.substr(canon, F.lit(3)), hex_, "abcdefghiklmnopr")))
             .otherwise(_shaped(canon, hex_, "abcdefghiklmnopr")))
    # a space that is used up: distinctness before format
    return F.when(attempt < 40, found).otherwise(F.concat(found, F.substring(hex_, 101, 16)))


def rendered(kind, mention, sur):
    """The surrogate with the separators, title and capitals of the mention."""
    n = F.length(mention)
    alnum = r"[0-9A-Za-z+]"
    kept = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), r"[^0-9A-Za-z+]", ""))
    one = lambda i: F.when(F.substr(mention, i, F.lit(1)).rlike(alnum), F.substr(sur, kept(i), F.lit(1))) \
        .otherwise(F.substr(mention, i, F.lit(1)))
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")
    rest = F.substr(sur, F.length(F.regexp_replace(mention, r"[^0-9A-Za-z+]", "")) + 1)
    title = F.regexp_extract(mention, rf"^{TITLE} ", 0)
    name = F.initcap(F.substr(sur, F.lit(3)))
    plain = F.regexp_replace(mention, rf"^{TITLE} ", "")
    name = F.when((plain == F.upper(plain)) & (F.length(plain) > 1), F.upper(name)).otherwise(name)
    return (F.when(kind.isin("iban", "card", "ssn", "phone"), F.concat(spaced, rest))
            .when(kind == "person", F.concat(title, name))
            .when((kind == "email") & (mention == F.upper(mention)), F.upper(sur))
            .otherwise(sur))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, sur`` for distinct ``kind, canon``: all ``sur`` of a kind differ from each
    other and from every ``canon`` of the kind.  Of entities that draw the same surrogate the
    smallest keeps it, the others draw again; each round is cut."""
    entities = cut(entities.select("kind", "canon").distinct())
    done = None
    pending, attempt = entities, 0
    while True:
        drawn = pending.withColumn("sur", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        claims = drawn.groupBy("kind", "sur").agg(F.min("canon").alias("winner"))
        claims = claims.join(entities.select("kind", F.col("canon").alias("sur")), ["kind", "sur"], "left_anti")
        if done is not None:
            claims = claims.join(done.select("kind", "sur"), ["kind", "sur"], "left_anti")
        won = claims.select("kind", F.col("winner").alias("canon"), "sur")
        done = cut(won if done is None else done.union(won))
        pending = cut(entities.join(done, ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            return done
        attempt += 1


def replace_private(docs: DataFrame, key: str = "surrogate-key-1", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``pii_entities`` (number of mentions replaced).

    Mentions of one entity get one surrogate in all documents, different entities different ones.
    Texts without entities are unchanged; null stays null with 0 entities.  Texts of equal content
    are resolved once, and only texts that hold an entity are shuffled; a hot text or entity is
    split by Spark's skewed-join handling.  Empty tables give empty results; repeated rows stay;
    columns keep their names and order.  Later runs agree as long as the key and the set of
    entities agree."""
    text = F.col(f"`{text_col}`")
    has = F.coalesce(text.rlike(CUE) & text.rlike(PATTERN), F.lit(False))
    digest = F.sha2(text, 256)
    found = docs.where(has).select(digest.alias("__pii_text"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("ents"))
    found = cut(found.groupBy("__pii_text").agg(F.first("ents").alias("ents")))
    mentions = found.select("__pii_text", F.posexplode("ents").alias("pos", "mention"))
    mentions = mentions.withColumn("kind", kind_of(F.col("mention"))).withColumn("kind", F.coalesce("kind", F.lit("secret")))
    mentions = cut(mentions.withColumn("canon", canonical(F.col("kind"), F.col("mention"))))
    table = surrogates(mentions, key)
    new = mentions.join(table, ["kind", "canon"]).select(
        "__pii_text", "pos", rendered(F.col("kind"), F.col("mention"), F.col("sur")).alias("new"))
    new = new.groupBy("__pii_text").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("__pii_new"))
    new = cut(new.select("__pii_text", F.col("__pii_new.new").alias("__pii_new")))
    between = F.split(text, PATTERN, -1)
    glued = F.array_join(F.zip_with(between, F.col("__pii_new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    columns = [F.col(f"`{c}`") if c != text_col else glued.alias(text_col) for c in docs.columns]
    changed = docs.where(has).withColumn("__pii_text", digest).join(new, "__pii_text") \
        .select(*columns, F.size("__pii_new").cast("bigint").alias("pii_entities"))
    same = docs.where(~has).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("bigint").alias("pii_entities"))
    return same.union(changed)
