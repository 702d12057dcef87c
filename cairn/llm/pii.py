"""PII surrogates: what is detected is replaced by keyed values of the same type and format.

One pattern finds the entities of a text in order. Each different entity of the corpus gets one surrogate, so a
repeated entity is replaced alike everywhere. Numbers, addresses and secrets go through a keyed permutation of
their own format (a Feistel network over the characters, each within its alphabet): two entities of one format
can't meet in one surrogate however many there are. Known prefixes, country codes and endings stay, check digits
are made again. A title shows a name, which is replaced word by word: given names by names of the same gender and
script, surnames by made-up ones, so that "Mr John Smith" and a later "Smith" remain one person.

A check over all entities finds surrogates that two entities share or that are themselves entities, and these are
drawn again with another permutation. What is left when a format is nearly full of entities changes places
among itself, which is distinct by construction and always ends. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let

TITLES = {
    "male": ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н"),
    "female": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Srta", "Doña", "Госпожа", "г-жа"),
    "any": ("Dr", "Prof", "Doctor", "Professor", "Mx"),
}
ALL_TITLES = tuple(t for titles in TITLES.values() for t in titles)
GIVEN = {
    ("latin", "male"): ("Adam", "Bruno", "Colin", "Daniel", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"),
    ("latin", "female"): ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Petra"),
    ("cyrillic", "male"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Степан", "Фёдор"),
    ("cyrillic", "female"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"),
}
SYLLABLES = {
    "latin": ("ra", "no", "li", "ve", "sto", "mi", "dan", "ker", "bel", "tor", "wen", "hal", "sim", "lan", "dor", "gar"),
    "cyrillic": ("ра", "но", "ли", "ве", "сто", "ми", "дан", "кер", "бел", "тор", "вен", "хал", "сим", "лан", "дор", "гар"),
}
#: Syllables that each try adds to a name.
MORE = (0, 1, 2, 4, 8, 16)
WORD = r"\p{Lu}[\p{L}'-]{1,40}"
#: Patterns of entities that no letter or digit precedes. Each is linear in the text: what it repeats without bound is a possessive run of single
#: characters, which starts only where the run does; groups repeat a bounded number of times (a domain name has at most 127 labels), as the matcher
#: goes one level deeper for each.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]++@[\p{L}\p{N}][\p{L}\p{N}-]{0,62}(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?){1,126}+",
    "secret": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|(?=[a-fA-F]{0,99}[0-9])[0-9a-fA-F]{32,}+|(?<=[=:\s\"'])(?<=[=:]\s{0,3}[\"']?)(?<=(?i:token|secret|api_key|apikey|api-key|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"']{6,}+)",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": r"(?<![:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ipv4": r"(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])",
    "number": r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}(?:[ -][0-9]{4}){2,3}|[0-9]{9,}+)(?![\p{L}\p{N}])",
    "passport": r"(?<=(?i:passport)(?: (?:no|nr|number)\.?)?[:#]? )[A-Z]{0,2}[0-9]{6,9}(?![\p{L}\p{N}])",
    "name": r"(?=\p{Lu})(?<= )(?<=(?<!\p{L})(?:" + "|".join(ALL_TITLES) + r")\.? )" + WORD + "(?: " + WORD + "){0,2}",
}
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"
#: No entity is without one of these, and texts without them are not searched further.
HINT = r"[0-9@=:]|sk-|gh[pousr]_|AKIA|" + "|".join(ALL_TITLES)
ASCII = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: First and last code point of the letters of other scripts, by case: Latin-1, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Chinese, Hangul.
BLOCKS = (
    (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA),
    (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
_BLOCKS = "array(" + ", ".join(f"named_struct('low', {low}L, 'high', {high}L)" for low, high in BLOCKS) + ")"
FEISTEL = 4  # rounds


def kind_of(entity: Column) -> Column:
    """The first kind but names whose pattern an entity fits whole; a secret's value shows by nothing else."""
    out = None
    for kind in ("email", "ipv4", "ipv6", "phone", "number", "iban"):
        fits = entity.rlike(f"^(?:{KINDS[kind]})$")
        out = F.when(fits, F.lit(kind)) if out is None else out.when(fits, F.lit(kind))
    return out.when(entity.rlike("^[A-Z]{0,2}[0-9]{6,8}$"), F.lit("passport")).otherwise(F.lit("secret"))


def entities(text: Column) -> Column:
    """The entities of a text in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def gender_before(part: Column) -> Column:
    """The gender that a title at the end of a text says, "any" of a title that says none; null without a title."""
    out = None
    for gender, titles in TITLES.items():
        met = F.substring(part, -16, 16).rlike(r"(?<!\p{L})(?:" + "|".join(titles) + r")\.? $")
        out = F.when(met, F.lit(gender)) if out is None else out.when(met, F.lit(gender))
    return out


def roles(found: Column) -> Column:
    """(role, entity) of what has a surrogate of its own: the words of a name, or the entity as a whole."""

    def of(x: Column) -> Column:
        words = F.split(x["entity"], " ")
        named = F.transform(words, lambda w, i: F.struct(role_of_word(i, F.size(words), x["gender"]).alias("role"), w.alias("entity")))
        return F.when(x["gender"].isNotNull(), named).otherwise(F.array(F.struct(x["kind"].alias("role"), x["entity"].alias("entity"))))

    return F.flatten(F.transform(found, of))


def role_of_word(i: Column, n: Column, gender: Column) -> Column:
    return F.when(i + 1 == n, F.lit("surname")).otherwise(F.concat(F.lit("given "), gender))


def _moved(c: Column, r: Column, hexadecimal: Column) -> Column:
    """A character moved r places on in its alphabet; marks stay."""

    def within(letters: str) -> Column:
        at = F.instr(F.lit(letters), c) - 1
        return F.substring(F.lit(letters), (F.pmod(at + r, F.lit(len(letters))) + 1).cast("int"), F.lit(1))

    out = None
    for letters in ("0123456789abcdef", "0123456789ABCDEF"):
        met = hexadecimal & (F.instr(F.lit(letters), c) > 0)
        out = F.when(c == "", c).when(met, within(letters)) if out is None else out.when(met, within(letters))
    for letters in ASCII:
        out = out.when(F.instr(F.lit(letters), c) > 0, within(letters))

    def other(point: Column) -> Column:
        block = F.get(F.filter(F.expr(_BLOCKS), lambda b: (point >= b["low"]) & (point <= b["high"])), F.lit(0))
        letter = lambda b: F.decode(F.unhex(F.lpad(F.hex(b["low"] + F.pmod(point - b["low"] + r, b["high"] - b["low"] + 1)), 4, "0")), "UTF-16BE")
        return let(block, lambda b: F.when(b.isNull(), c).otherwise(letter(b)))

    return out.otherwise(F.when(c.rlike(r"\p{L}"), let(F.ascii(c), other)).otherwise(c))


def permuted(text: Column, key: Column, hexadecimal: Column) -> Column:
    """A keyed permutation of the strings of text's format: either half in turn is moved by a digest of the other."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.lit(2**30)).alias("b"), hexadecimal.alias("hex"), key.alias("key"))

    def shift(s: Column, digest: Column, hexa: Column) -> Column:
        return let(digest, lambda seed: F.array_join(F.transform(F.split(s, ""), lambda c, i: _moved(c, F.pmod(F.xxhash64(seed, i), F.lit(1 << 30)), hexa)), ""))

    def step(state: Column, j: Column) -> Column:
        first = j % 2 == 0
        digest = F.sha2(F.concat_ws("|", state["key"], j.cast("string"), F.when(first, state["a"]).otherwise(state["b"])), 256)
        moved = shift(F.when(first, state["b"]).otherwise(state["a"]), digest, state["hex"])
        return F.struct(F.when(first, state["a"]).otherwise(moved).alias("a"), F.when(first, moved).otherwise(state["b"]).alias("b"), state["hex"].alias("hex"), state["key"].alias("key"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _octets(entity: Column, key: Column) -> Column:
    """Octets from 1 to 254 permuted likewise; 0 and 255 stay."""

    def step(o: Column, j: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", key, j.cast("string"), F.array_join(F.when(j % 2 == 0, F.slice(o, 1, 2)).otherwise(F.slice(o, 3, 2)), ".")), 256)
        moves = lambda i: F.when(j % 2 == 0, i >= 2).otherwise(i < 2)
        return F.transform(o, lambda v, i: F.when(moves(i) & (v >= 1) & (v <= 254), F.pmod(v - 1 + F.pmod(F.xxhash64(seed, i), F.lit(254)).cast("int"), F.lit(254)) + 1).otherwise(v))

    numbers = F.transform(F.split(entity, r"\."), lambda o: o.cast("int"))
    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL - 1)), numbers, step).cast("array<string>"), ".")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.char_length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10


def _mod97(text: Column) -> Column:
    """An IBAN's characters, those of the country and check digits last, as a number modulo 97 (letters count from 10)."""

    def add(total: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + letter) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c.rlike("[0-9A-Z]")), F.lit(0), add)


def _name(entity: Column, role: Column, key: Column, extra: int) -> Column:
    """A given name of the role's gender or a made-up surname, in the entity's script and case; extra syllables make more of them."""

    def word(seed: Column) -> Column:
        def pick(values: tuple[str, ...], i: int) -> Column:
            return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(len(values))) + 1).cast("int"))

        cyrillic = entity.rlike(r"\p{IsCyrillic}")
        out = None
        for (script, gender), names in GIVEN.items():
            own = cyrillic if script == "cyrillic" else ~cyrillic
            either = (role == "given any") & (F.pmod(F.xxhash64(seed), F.lit(2)) == (0 if gender == "male" else 1))
            value = F.concat(pick(names, 0), *(pick(SYLLABLES[script], i) for i in range(1, extra + 1)))
            case = own & ((role == f"given {gender}") | either)
            out = F.when(case, value) if out is None else out.when(case, value)
        latin = F.concat(*(pick(SYLLABLES["latin"], i) for i in range(2 + extra)))
        ending = F.when(entity.rlike("[ая]$"), F.lit("ова")).otherwise(F.lit("ов"))
        russian = F.concat(*(pick(SYLLABLES["cyrillic"], i) for i in range(1 + extra)), ending)
        made = F.initcap(out.otherwise(F.when(cyrillic, russian).otherwise(latin)))
        return F.when((F.char_length(entity) > 1) & (entity == F.upper(entity)), F.upper(made)).otherwise(made)

    return let(F.sha2(F.concat_ws("|", key, role, entity), 256), word)


def surrogate(entity: Column, role: Column, key: str, attempt: int) -> Column:
    """A candidate for an entity; another attempt gives another. Within a format no two entities have the same.

    What stands before or after the part that is permuted stays: a country, a known prefix, an ending. An IBAN's
    check digits and the check digit of a number that had a valid one are made again.
    """
    own = F.concat_ws("|", F.lit(f"{key}|{attempt}"), role)
    digits = lambda x: F.regexp_replace(x, "[ -]", "")
    valid = (role == "number") & (F.char_length(digits(entity)) >= 12) & (_luhn(digits(entity)) == 0)
    ending = F.when(role == "email", F.regexp_extract(entity, r"\.[^.]*$", 0)).when(valid, F.substring(entity, -1, 1)).otherwise(F.lit(""))
    known = F.when(role == "secret", F.regexp_extract(entity, r"^(?:AKIA|gh[pousr]_|sk-)", 0)).when(role == "phone", F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ .(-])", 0))
    start = known.when(role == "iban", F.substring(entity, 1, 4)).otherwise(F.lit(""))
    hexadecimal = (role == "ipv6") | (role == "secret") & entity.rlike("^[0-9a-f]+$|^[0-9A-F]+$")

    def finished(x: Column) -> Column:
        core, country = x["core"], F.substring(x["start"], 1, 2)
        account = F.concat(country, F.lpad((98 - _mod97(F.concat(core, country, F.lit("00")))).cast("string"), 2, "0"), core)
        check = F.pmod(10 - _luhn(digits(F.concat(core, F.lit("0")))), F.lit(10)).cast("string")
        return F.when(role == "iban", account).when((role == "number") & (x["ending"] != ""), F.concat(core, check)).otherwise(F.concat(x["start"], core, x["ending"]))

    def plain(x: Column) -> Column:
        n = F.char_length(x["start"])
        core = F.substring(entity, n + 1, F.char_length(entity) - n - F.char_length(x["ending"]))
        return let(F.struct(permuted(core, own, hexadecimal).alias("core"), x["start"].alias("start"), x["ending"].alias("ending")), finished)

    named = _name(entity, role, own, MORE[min(attempt, len(MORE) - 1)])
    return F.when(is_name(role), named).when(role == "ipv4", _octets(entity, own)).otherwise(let(F.struct(start.alias("start"), ending.alias("ending")), plain))


def is_name(role: Column) -> Column:
    return (role == "surname") | role.startswith("given")


def assign(found: DataFrame, key: str, rounds: int = len(MORE)) -> DataFrame:
    """(role, entity, surrogate) of every different row of found (role, entity), no two surrogates alike.

    None is an entity itself as long as the format has other values. After the rounds, what is left of a format
    takes the place of each other; a value that is the only one of its format, or has nothing in it that can be
    changed, becomes a keyed string of letters and digits, of 32 at least.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = cut(found.select("role", "entity").repartition(parts, "role", "entity").distinct())
    known = todo.select(F.col("entity").alias("surrogate")).distinct()
    done: list[DataFrame] = []
    for attempt in range(rounds):
        tried = cut(todo.repartition(parts, "role", "entity").withColumn("surrogate", surrogate(F.col("entity"), F.col("role"), key, attempt)))
        free = tried.groupBy("surrogate").agg(F.min(F.struct("role", "entity")).alias("w")).join(known, "surrogate", "left_anti")
        for before in done:
            free = free.join(before.select("surrogate"), "surrogate", "left_anti")
        done.append(cut(free.select("w.role", "w.entity", "surrogate")))
        todo = cut(tried.select("role", "entity").join(done[-1].select("role", "entity"), ["role", "entity"], "left_anti"))
        if todo.isEmpty():
            break
    else:
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("entity", r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a"), r"\p{N}", "0")
        rest = todo.withColumn("shape", shape).withColumn("at", F.xxhash64(F.lit(key), "entity"))
        ring = Window.partitionBy("role", "shape").orderBy("at", "entity")
        after = F.coalesce(F.lead("entity").over(ring), F.first("entity").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        digest = F.sha2(F.concat_ws("|", F.lit(key), "role", "entity"), 256)
        relaxed = F.substring(digest, F.lit(1), F.greatest(F.lit(32), F.least(F.lit(64), F.char_length("entity"))))
        done.append(cut(rest.withColumn("surrogate", after).select("role", "entity", F.when((F.col("surrogate") == F.col("entity")) | is_name(F.col("role")), relaxed).otherwise(F.col("surrogate")).alias("surrogate"))))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def replace_pii(docs: DataFrame, key: str = "public-example-key", everywhere: bool = True) -> DataFrame:
    """The rows of docs, all columns, text with surrogates, and _n_entities (what the pattern found in the text).

    The pattern goes over each text once. Texts meet their surrogates by a digest of the text, so copies share
    the work and an entity or text that is very frequent is aggregated before it is joined. With everywhere, a word
    that a title showed as a name in any document is replaced in all of them where it stands with its capital; else only in
    the documents where a title shows it.

    Defined results: null texts stay null; a text without entities stays as it is; repeated rows stay; an empty
    table gives an empty table; formats that are full of entities end as assign() says; a column of docs named
    like those used here keeps its values.
    """
    slots = [f"_c{i}" for i in range(len(docs.columns))]
    at_text = slots[docs.columns.index("text")]
    text = F.col(at_text)
    rows = cut(docs.select(*(F.col(f"`{c}`").alias(s) for c, s in zip(docs.columns, slots, strict=True))).withColumn("_e", F.coalesce(entities(text), F.array().cast("array<string>"))))
    hits = rows.where(F.size("_e") > 0).withColumn("_t", F.md5(text.cast("binary")))
    found = F.zip_with(F.slice("_p", F.lit(1), F.size("_e")), "_e", lambda p, e: F.struct(e.alias("entity"), gender_before(p).alias("gender")))
    found = F.transform(found, lambda x: F.struct(x["entity"].alias("entity"), x["gender"].alias("gender"), F.when(x["gender"].isNull(), kind_of(x["entity"])).alias("kind")))
    hits = cut(hits.withColumn("_p", F.split(text, ANY, -1)).withColumn("_x", found).drop("_e", at_text))
    per_text = cut(hits.select("_t", F.explode(F.array_distinct(roles(F.col("_x")))).alias("r")).select("_t", "r.role", "r.entity").distinct())
    named = assign(per_text.select("role", "entity"), key)
    own = per_text.join(named, ["role", "entity"])
    kept = [*slots, "_n_entities"]
    names = cut(named.where(is_name(F.col("role"))).groupBy("entity").agg(F.min(F.struct("role", "surrogate")).alias("s")).select("entity", F.lit("word").alias("role"), F.col("s.surrogate").alias("surrogate")))
    spread = everywhere and not names.isEmpty()
    without = rows.where(F.size("_e") == 0).drop("_e")
    if spread:
        words = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}'-])" + WORD), F.lit(0)))).alias("entity")
        met = rows.select(F.md5(text.cast("binary")).alias("_t"), words).distinct().join(names, "entity")
        own = own.unionByName(met.select("role", "entity", "_t", "surrogate"))
        without = without.withColumn("_t", F.md5(text.cast("binary"))).withColumn("_p", F.array(text)).withColumn("_x", F.array().cast(hits.schema["_x"].dataType)).drop(at_text)
        hits = hits.unionByName(without)
    maps = own.groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "role", "entity"), "surrogate"))).alias("_m"))
    joined = hits.join(maps, "_t", "left")
    name_words = F.filter(F.map_entries("_m"), lambda x: is_name(F.substring_index(x["key"], "|", 1)) | x["key"].startswith("word|"))
    joined = joined.withColumn("_n", F.coalesce(name_words, F.array().cast("array<struct<key:string,value:string>>")))
    joined = joined.withColumn("_p", F.when(F.size("_n") > 0, F.transform("_p", lambda p: _names_in(p, F.col("_n")))).otherwise(F.col("_p")))

    def value(x: Column) -> Column:
        words = F.split(x["entity"], " ")
        of = lambda role, entity: F.element_at(F.col("_m"), F.concat_ws("|", role, entity))
        name = F.array_join(F.transform(words, lambda w, i: of(role_of_word(i, F.size(words), x["gender"]), w)), " ")
        return F.when(x["gender"].isNotNull(), name).otherwise(of(x["kind"], x["entity"]))

    made = F.concat(F.array_join(F.zip_with(F.slice("_p", F.lit(1), F.size("_x")), "_x", lambda p, x: F.concat(p, value(x))), ""), F.element_at("_p", -1))
    changed = joined.withColumn(at_text, made).withColumn("_n_entities", F.size("_x").cast("long")).select(*kept)
    if not spread:
        changed = changed.unionByName(without.withColumn("_n_entities", F.lit(0).cast("long")).select(*kept))
    return changed.select(*(F.col(s).alias(c) for c, s in zip(docs.columns, slots, strict=True)), "_n_entities")


def _names_in(part: Column, names: Column) -> Column:
    """The text between entities with the words of names that a title showed elsewhere replaced too."""

    def one(p: Column, n: Column) -> Column:
        word = F.substring_index(n["key"], "|", -1)
        return F.when(F.contains(p, word), F.regexp_replace(p, F.concat(F.lit(r"(?<![\p{L}\p{N}'-])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}'-])")), n["value"])).otherwise(p)

    return F.aggregate(names, part, one)
