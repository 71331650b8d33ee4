"""Surrogates for personal data, in DataFrame expressions only.

One pattern finds entities: e-mail and network addresses, phone and card numbers, keys, tokens and passwords,
and names after an honorific. An entity is its kind and canonical form: e-mail addresses without case, numbers without
separators, names word by word (given name and surname apart, so "Mr Smith" and "Mr John Smith" share a surname).
Each gets a replacement derived from a keyed SHA-512 of both: digits become digits, letters letters of the same
script and case; card numbers keep their first digit and a right check digit, network addresses stay addresses,
hexadecimal strings stay hexadecimal; names become names of the same script, given names (and Cyrillic surnames) of the
honorific's gender. Each written form then takes its entity's replacement in its own case and separators. As the
replacement depends on the canonical form alone, an entity has the same one in every document.

All entities of the corpus are checked against each other, whatever their kind: where two would get one replacement,
or one's replacement is another's real form, the first by hash keeps it and the others go to the next attempt, until
none is left. Names and the first part of addresses grow with the attempts, so short ones don't run out. A kind
of fixed length with more entities than it has values raises an error.

All patterns are linear: every repetition is bounded or cannot be retried, and no group repeats without a bound.

Null text stays null, an empty text is empty. Rows and columns are kept, but for a column n_replaced, which is
replaced; repeated rows get equal results. An empty table gives an empty result. Texts are known by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEY = "quire-surrogates"
ATTEMPTS = 64
_DOMAIN = r"[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+"
HONORIFIC = r"(?:M(?:r|ister|rs|s|iss|onsieur|adame|ademoiselle)|Herrn?|Frau|Señor(?:a|ita)?|Г-(?:н|жа))\.? "
#: Kinds in the order in which the pattern tries them; none starts inside a word.
KINDS = {
    "email": rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]{{0,254}}+@{_DOMAIN}",
    "secret": r"(?i:pass(?:word|wd)|pwd|token|secret|a(?:pi|ccess)[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{6,}+",
    "key": r"A[KS]IA[0-9A-Z]{16}(?![\p{L}\p{N}])|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9]{20,}+",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.[0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![\p{L}\p{N}])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\p{L}\p{N}])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\p{L}\p{N}])|(?<![.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])",
    "name": HONORIFIC + r"\p{Lu}\p{L}++(?: \p{Lu}\p{L}++)?+",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"
#: What stays before a secret or key.
HEAD = r"^(?:(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?|AKIA|ASIA|gh[pousr]_|sk-)"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Г-жа)"
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_ACCENTED = (("àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ", 1), ("ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ", 2))

#: Given names by script and gender; a later attempt joins several.
GIVEN = {
    "latin": {
        "m": "Adam Albert Arthur Benjamin Bruno Carl Daniel David Edgar Edward Emil Eric Felix Frank George Gustav Henry Hugo Ivan Jacob Leo Louis Lucas Martin Max Nathan Oliver Oscar Otto Paul Peter Philip Ralph Robert Samuel Simon Theo Thomas Victor Walter".split(),
        "f": "Ada Agnes Alice Amelia Anna Beatrice Bertha Cara Clara Diana Edith Elena Ella Emma Esther Eva Flora Frida Grace Hanna Helen Ida Irene Iris Jane Julia Laura Lena Lily Lucia Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
    },
    "cyrillic": {
        "m": "Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён Степан Тимур Фёдор".split(),
        "f": "Алла Анна Валентина Вера Галина Дарья Евгения Елена Зоя Инна Ирина Ксения Лариса Мария Нина Ольга Полина Раиса София Юлия".split(),
    },
    "greek": {
        "m": "Αλέξης Ανδρέας Γιάννης Δήμος Ηλίας Κώστας Λουκάς Μάνος Νίκος Πέτρος Σπύρος Στέφανος".split(),
        "f": "Άννα Δάφνη Ειρήνη Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νεφέλη Σοφία".split(),
    },
}
#: Surnames are a beginning, middles (one more an attempt) and an ending.
SURNAME = {
    "latin": (
        "Ald Bar Bren Cal Car Dal Der Ed Fal Far Gar Gil Hal Har Hol Ing Kel Kir Lan Lin Mar Mel Mor Nor Oak Pel Per Ral Rand Sel Shel Stan Tal Thorn Ul Val Wal Wes Win Yar".split(),
        "a e i o an en er el in ol or um ber den der gan ler man ner per ser ter ven vin".split(),
        {g: "by combe den don field ford grove ham hurst ing ley lock low man mere more ridge sen son stead ton ville well worth".split() for g in "mf"},
    ),
    "cyrillic": (
        "Аб Бар Бел Вол Гор Дан Ер Жар Зим Каз Кол Лаз Мар Мор Нест Орл Пан Рог Сав Тар Ул Фад Хар Шум".split(),
        "а е и о ан ен ер ил ин ол он ур ам ат ак ар".split(),
        {"m": "ов ев ин ский цов".split(), "f": "ова ева ина ская цова".split()},
    ),
    "greek": (
        "Αγγελ Βασιλ Γεωργ Δημητρ Ευαγγελ Ζαχαρ Θεοδωρ Καλλ Κων Λαμπρ Μαρκ Νικολ Παπα Σταμ Τριαντ Χριστ".split(),
        "α ε ι ο αν εν ιν ον αρ ερ ακ ατ".split(),
        {"m": "όπουλος ίδης άκης άτος έας".split(), "f": "οπούλου ίδου άκη άτου έα".split()},
    ),
}


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, p in reversed(list(KINDS.items())[:-1]):
        out = F.when(entity.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"[\u0400-\u04FF]"), "cyrillic").when(word.rlike(r"[\u0370-\u03FF]"), "greek").otherwise("latin")


def parts_of(kind: Column, form: Column) -> Column:
    """A written form's parts: array of struct(kind, canon, before, piece); before is what stays in front of the piece."""
    part = lambda k, canon, before, piece: F.struct(k.alias("kind"), canon.alias("canon"), before.alias("before"), piece.alias("piece"))
    nothing = F.lit("")
    head = F.when(kind.isin("secret", "key"), F.regexp_extract(form, HEAD, 0)).otherwise(nothing)
    body = F.substring(form, F.length(head) + 1, F.length(form))
    canon = F.when(kind == "email", F.lower(form)).when(kind.isin("card", "phone", "ssn", "iban"), F.regexp_replace(form, r"[^0-9A-Z]", "")).otherwise(body)
    title = F.regexp_extract(form, "^" + HONORIFIC, 0)
    words = F.split(F.substring(form, F.length(title) + 1, F.length(form)), " ")
    gender = F.when(form.rlike(FEMALE), "f").otherwise("m")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    # a Cyrillic surname has its bearer's gender, others serve both
    surname = lambda w: F.concat(F.lit("surname_"), F.when(_script(w) == "latin", "m").otherwise(gender))
    named = F.when(F.size(words) > 1, F.array(part(F.concat(F.lit("given_"), gender), F.lower(first), title, first), part(surname(last), F.lower(last), F.lit(" "), last))).otherwise(F.array(part(surname(last), F.lower(last), title, last)))
    return F.when(kind == "name", named).otherwise(F.array(part(kind, canon, head, body)))


def _number(digest: Column, i: Column) -> Column:
    """The i-th number below 65,536 of a hexadecimal digest of 128 digits; 125 of them, then around."""
    return F.conv(F.substring(digest, 1 + F.pmod(3 * i, F.lit(125)), F.lit(4)), 16, 10).cast("int")


def _pick(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.pmod(number, F.lit(len(names))) + 1)


def _letter(c: Column, number: Column, hexadecimal: Column) -> Column:
    out = c
    pick = lambda a: F.substring(F.lit(a), F.pmod(number, F.lit(len(a))) + 1, F.lit(1))
    for letters, k in _ACCENTED:
        out = F.when(F.lit(letters).contains(c), pick(ALPHABETS[k])).otherwise(out)
    for a in ALPHABETS:
        out = F.when(F.lit(a).contains(c), pick(a)).otherwise(out)
    return F.when(hexadecimal & F.lit("0123456789abcdef").contains(c), pick("0123456789abcdef")).otherwise(out)


def _luhn(digits: Column) -> Column:
    """The digits with the last replaced by the check digit."""
    n = F.length(digits)
    digit = lambda k: F.substring(digits, n - k, F.lit(1)).cast("int")
    # places counted from the right, the check digit at 0: every odd place counts twice
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda acc, k: acc + F.when(k % 2 == 1, twice(digit(k))).otherwise(digit(k)))
    return F.concat(F.substring(digits, F.lit(1), n - 1), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _named(kind: Column, canon: Column, digest: Column, attempt: Column) -> Column:
    """A name of the kind and the word's script, in lower case."""
    out = F.lit(None).cast("string")
    script = _script(canon)
    several = lambda names, first: F.array_join(F.transform(F.sequence(F.lit(first), attempt + first), lambda i: _pick(names, _number(digest, i))), "")
    for s in GIVEN:
        for g in "mf":
            begin, middle, end = SURNAME[s][0], SURNAME[s][1], SURNAME[s][2][g]
            # attempt k: k + 1 given names in one, or k + 1 middles
            family = F.concat(_pick(begin, _number(digest, F.lit(0))), several(middle, 2), _pick(end, _number(digest, F.lit(1))))
            out = F.when((script == s) & (kind == f"given_{g}"), several(GIVEN[s][g], 0)).when((script == s) & (kind == f"surname_{g}"), family).otherwise(out)
    return F.lower(out)


def with_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities (kind, canon, attempt) with sc, the replacement of the canonical form.

    Built up column by column, so that no expression holds another one twice.
    """
    kind, canon = F.col("kind"), F.col("canon")
    t = entities.withColumn("_digest", F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.col("attempt").cast("string")), 512))
    # what stays: a number's first digit, an account's country, an address's last label
    t = t.withColumn("_from", F.when(kind.isin("card", "phone"), 2).when(kind == "iban", 3).otherwise(1))
    t = t.withColumn("_upto", F.length(canon) - F.when(kind == "email", F.length(F.substring_index(canon, ".", -1)) + 1).otherwise(F.lit(0)))
    t = t.withColumn("_hex", kind.isin("secret", "key") & canon.rlike("^[0-9a-f]+$"))
    chars = F.transform(F.sequence(F.lit(1), F.length(canon)), lambda i: F.struct(i.alias("i"), F.substring(canon, i, F.lit(1)).alias("c"), _number(F.col("_digest"), i).alias("n")))
    t = t.withColumn("_chars", F.when(~kind.rlike("^(?:given|surname)_"), chars))
    t = t.withColumn("_plain", F.array_join(F.transform("_chars", lambda x: F.when((x["i"] > F.col("_upto")) | (x["i"] < F.col("_from")), x["c"]).otherwise(_letter(x["c"], x["n"], F.col("_hex")))), ""))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_number(F.col("_digest"), i), F.lit(254)) + 1).cast("string")), ".")
    # every eighth attempt puts one more letter before an address
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.col("attempt")), lambda i: F.when(i % 8 == 0, F.substring(F.lit(ALPHABETS[1]), F.pmod(_number(F.col("_digest"), 60 + i), F.lit(26)) + 1, F.lit(1))).otherwise("")), "")
    grown = F.when(F.col("attempt") < 8, F.col("_plain")).otherwise(F.concat(more, F.col("_plain")))
    sc = F.when(kind == "ip", octets).when(kind == "card", _luhn(F.col("_plain"))).when(kind == "email", grown).when(F.col("_chars").isNotNull(), F.col("_plain")).otherwise(_named(kind, canon, F.col("_digest"), F.col("attempt")))
    return t.withColumn("sc", sc).drop("_digest", "_from", "_upto", "_hex", "_chars", "_plain")


def rendered(kind: Column, piece: Column, sc: Column) -> Column:
    """The replacement as the piece is written: its separators and its case."""
    rank = lambda i: F.length(F.regexp_replace(F.substring(piece, F.lit(1), i), r"[^0-9A-Z]", ""))
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(piece)), lambda i: F.when(F.substring(piece, i, F.lit(1)).rlike("[0-9A-Z]"), F.substring(sc, rank(i), F.lit(1))).otherwise(F.substring(piece, i, F.lit(1)))), "")
    shout = (piece == F.upper(piece)) & (piece != F.lower(piece)) & (F.length(piece) > 1)
    cased = F.array_join(F.transform(F.sequence(F.lit(1), F.length(sc)), lambda i: F.when(F.substring(piece, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(sc, i, F.lit(1)))).otherwise(F.substring(sc, i, F.lit(1)))), "")
    title = F.concat(F.upper(F.substring(sc, F.lit(1), F.lit(1))), F.substring(sc, F.lit(2), F.length(sc)))
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), spaced)
        .when(kind == "email", F.when(shout, F.upper(sc)).when(F.length(sc) == F.length(piece), cased).otherwise(sc))
        .when(kind.isin("secret", "key", "ip"), sc)
        .otherwise(F.when(shout, F.upper(sc)).otherwise(title))
    )


def _entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), 0)


def settle(entities: DataFrame, key: str = KEY, replace=with_surrogates, limit: int = ATTEMPTS) -> DataFrame:
    """entities (saved: kind, canon, distinct) with sc, a replacement that is theirs alone and no entity's real form.

    Each attempt tries those that clashed in the one before; what is settled is not written again.
    """
    real = entities.select(F.col("canon").alias("rc")).distinct()
    now, done = entities.select("kind", "canon").withColumn("attempt", F.lit(0)), []
    for _ in range(limit):
        tried = common.save(replace(now, key), "tried")
        # of several entities with one replacement the first by hash has it, unless it is a real form or taken already
        first = tried.groupBy("sc").agg(F.min(F.struct(F.xxhash64("kind", "canon").alias("h"), "kind", "canon")).alias("f"))
        free = first.join(real, F.col("sc") == F.col("rc"), "left_anti")
        for d in done:
            free = free.join(d.select(F.col("sc").alias("ds")), F.col("sc") == F.col("ds"), "left_anti")
        won = common.save(free.select(F.col("f.kind").alias("kind"), F.col("f.canon").alias("canon"), "sc"), "settled")
        done.append(won)
        lost = tried.join(won.select(F.col("kind").alias("wk"), F.col("canon").alias("wc")), (F.col("kind") == F.col("wk")) & (F.col("canon") == F.col("wc")), "left_anti")
        now = common.save(lost.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "pending")
        common.discard(tried)
        if now.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
    raise ValueError(f"no replacement of its own for some entity after {limit} attempts")


def anonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text replaced, and n_replaced (int): how many entities it held."""
    text = F.col("text").cast("string")
    t_, s_ = common.fresh(docs, "t", "s")
    # one look for entities; a text is known by its hash from here on, and a hot text is one row
    hits = docs.select(text.alias("text")).withColumn("e", _entities(F.col("text"))).where(F.size("e") > 0)
    hits = common.save(hits.groupBy(F.unhex(F.sha2("text", 256)).alias("t")).agg(F.first("e").alias("e")), "hits")
    forms = common.save(hits.select(F.explode("e").alias("form")).distinct().withColumn("kind", kind_of(F.col("form"))), "forms")
    parts = common.save(forms.select("form", F.posexplode(parts_of(F.col("kind"), F.col("form"))).alias("at", "p")).select("form", "at", "p.*"), "parts")
    entities = common.save(parts.select("kind", "canon").distinct(), "entities")
    settled = common.save(settle(entities, key).select(F.col("kind").alias("sk"), F.col("canon").alias("sn"), "sc"), "replacements")
    found = parts.join(common.sized(settled, 256), (F.col("kind") == F.col("sk")) & (F.col("canon") == F.col("sn")))
    found = found.select("form", "at", F.concat("before", rendered(F.col("kind"), F.col("piece"), F.col("sc"))).alias("s"))
    table = common.save(found.groupBy("form").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "s")))["s"], "").alias("s")), "table")
    common.discard(forms, parts, entities, settled)
    spread = hits.select("t", F.posexplode("e").alias("at", "entity")).join(common.sized(table, 256), F.col("entity") == F.col("form"))
    lists = spread.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("s"))
    lists = common.save(lists.select(F.col("t").alias(t_), F.col("s.s").alias(s_)), "lists")
    common.discard(hits, table)
    gaps = F.split(text, PATTERN, -1)
    swapped = F.zip_with(F.slice(gaps, 1, F.size(s_)), F.col(s_), lambda g, s: F.concat(g, s))
    whole = F.concat(F.array_join(swapped, ""), F.element_at(gaps, -1))
    columns = [c for c in docs.columns if c.lower() != "n_replaced"]

    def swap(rows: DataFrame, lists: DataFrame) -> DataFrame:
        count = F.when(F.col(s_).isNull(), 0).otherwise(F.size(s_)).alias("n_replaced")
        new = F.when(F.col(s_).isNotNull(), whole).otherwise(text)
        out = rows.join(lists, F.unhex(F.sha2(text, 256)) == F.col(t_), "left")
        return out.select(*(new.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns), count)

    size = lists.agg(F.sum(F.octet_length(F.array_join(s_, "")) + 16 * F.size(s_) + 128)).first()[0] or 0
    if size <= common.BROADCAST_BYTES:
        return swap(docs, F.broadcast(lists))
    # a second look at the texts costs less than a shuffle of all of them
    has = F.coalesce(text.rlike(PATTERN), F.lit(False))
    bare = docs.where(~has).select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns), F.lit(0).alias("n_replaced"))
    return swap(docs.where(has), lists).unionByName(bare)
