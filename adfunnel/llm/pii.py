"""PII surrogates (DataFrame functions only).

Detected entities get replacements of the same type and form. A replacement is
derived from a secret key and the entity alone, so the same entity gets the
same one in every document (coreference), and without the key it can't be
turned back. Distinct entities keep distinct replacements: all entities of the
corpus are one table, where replacements that meet each other or a real entity
are drawn again until none does.

Form is kept character by character: digits become digits, letters become
letters of their script and case, vowels vowels where the script is Latin,
Cyrillic or Greek (letters of scripts not listed become Latin ones);
punctuation stays. A form without a free member is left. Card numbers keep their check digit right, IP addresses
stay in range, e-mail hosts keep the top-level name, given names are taken from
names of the same gender and script, and the last letter of other names, which
often marks gender, stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm._store import Scratch

#: Fixed values. Types in the order of precedence, with their patterns.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
CARD = r"(?<!\d)(?:\d{4}(?:[ -]?\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}|3[47]\d{13}|3[0689]\d{12})(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
#: 3-3-4 with separators; any country code and 8 digits or more; ten digits that can be an area code and number.
PHONE = (
    r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d+])\+(?=(?:[ .()-]{0,2}\d){8})\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)"
    r"|(?<![\w.+])[2-9]\d{2}[2-9]\d{6}(?!\w|\.\d)"
)
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа")
OTHER_TITLES = ("Dr", "Prof")
MALE_LATIN = ("Adam", "Brian", "Carlos", "David", "Erik", "Felix", "George", "Henri", "Ivan", "James", "Karl", "Louis", "Martin", "Nicolas", "Oscar", "Peter")
FEMALE_LATIN = ("Anna", "Beatrice", "Clara", "Diana", "Emma", "Frances", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nina", "Olivia", "Paula", "Sofia")
MALE_CYRILLIC = ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей")
FEMALE_CYRILLIC = ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна")
PERSON = r"\b(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + r")\b\.? \p{Lu}[\p{L}\p{M}'-]+(?: \p{Lu}[\p{L}\p{M}'-]+)?"
TYPES = [("email", EMAIL), ("card", CARD), ("ip", IP), ("ssn", SSN), ("phone", PHONE), ("person", PERSON)]
#: Letters that take each other's place.
LETTERS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "ъь", "ЪЬ", "іїє", "ІЇЄ", "ўґђѓјљњћќџѕ", "ЎҐЂЃЈЉЊЋЌЏЅ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "άέήίόύώϊϋΐΰ", "ΆΈΉΊΌΎΏΪΫ", "ςνρ",
    "àáâãäåāăąæèéêëēĕėęěìíîïĩīĭįòóôõöøōŏőœùúûüũūŭůűųýÿŷ", "ÀÁÂÃÄÅĀĂĄÆÈÉÊËĒĔĖĘĚÌÍÎÏĨĪĬĮÒÓÔÕÖØŌŎŐŒÙÚÛÜŨŪŬŮŰŲÝŸŶ",
    "çćĉċčďđĝğġģĥħĵķĺļľłñńņňŕŗřśŝşšţťŧŵźżžðþß", "ÇĆĈĊČĎĐĜĞĠĢĤĦĴĶĹĻĽŁÑŃŅŇŔŖŘŚŜŞŠŢŤŦŴŹŻŽÐÞ",
]
#: Other letters by script (Java patterns), and what takes their place; the last ones leave the script, not the case.
SCRIPTS = [
    (r"\p{IsHan}", "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"), (r"\p{IsHangul}", "김이박최정강조윤장임한오서신권황안송류홍"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねの"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノ"),
    (r"[\p{IsArabic}&&\p{L}]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"[\p{IsHebrew}&&\p{L}]", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"[\p{IsArmenian}&&\p{Lu}]", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀ"), (r"[\p{IsArmenian}&&\p{L}]", "աբգդեզէըթժիլխծկհ"), (r"[\p{IsGeorgian}&&\p{Ll}\p{Lo}]", "აბგდევზთიკლმნოპრსტუფქღყშჩცძწჭხჯჰ"),
    (r"[\p{IsDevanagari}&&\p{L}]", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"), (r"[\p{IsThai}&&\p{L}]", "กขคงจฉชซดตถทนบปผฝพฟภมยรลวสหอ"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"), (r"[\p{IsCyrillic}&&\p{L}]", "бвгджзклмнпрстфхцчшщ"), (r"[\p{IsGreek}&&\p{Lu}]", "ΑΕΗΙΟΥΩ"), (r"[\p{IsGreek}&&\p{L}]", "αεηιουω"),
    (r"[\p{Lu}\p{Lt}]", "ABCDEFGHIJKLMNOPRSTUVZ"), (r"\p{L}", "abcdefghijklmnoprstuvz"),
]

_ALL = "|".join(p for _, p in TYPES)
#: What a text must have for any of the patterns.
_MAY = r"[@]|\d[ .-]?\d|\b(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + r")\b"


def _draw(key: str, salt: str, n: str, at: str) -> str:
    """SQL for a number in 0..n-1 from the keyed hash of the entity, the attempt and the place."""
    return f"pmod(cast(conv(substr(sha2(concat_ws('|', '{key}', type, name, attempt, '{salt}', {at}), 256), 1, 12), 16, 10) as bigint), {n})"


def _by_form(key: str, salt: str, column: str) -> str:
    """SQL that replaces each character by one of its class."""
    cases = "".join(f" when instr('{s}', c) > 0 then substr('{s}', int({_draw(key, salt, str(len(s)), 'i')}) + 1, 1)" for s in LETTERS)
    other = "".join(f" when c rlike '{p}' then substr('{s}', int({_draw(key, salt, str(len(s)), 'i')}) + 1, 1)" for p, s in [(p.replace("\\", "\\\\"), s) for p, s in SCRIPTS])
    digit = f" when c between '0' and '9' then cast({_draw(key, salt, '10', 'i')} as string)"
    return f"array_join(transform(split({column}, ''), (c, i) -> case when c = '' then ''{digit}{cases}{other} else c end), '')"


def _more(key: str, every: int, digits: bool) -> str:
    """SQL for the characters that a surrogate grows by, one more every so many attempts, so that no form can run out."""
    drawn = f"substr(sha2(concat_ws('|', '{key}', type, name, attempt, 'x'), 256), 1, int(attempt / {every}))"
    return f"translate({drawn}, 'abcdef', '012345')" if digits else drawn


def _quoted(names: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (type, name, attempt) with ``surrogate``; a pure function of these and the key.

    A person is a surname here; given names are types of their own, by gender
    (given_m, given_f, given_n).

    From the second attempt on the same entity gets another draw; after some
    attempts surrogates of every type leave their form, names and e-mail
    addresses by a letter every four, the others by a digit every sixteen, so
    that no form can run out.
    """
    key = key.replace("\\", "").replace("'", "")
    d = entities
    whole = _by_form(key, "", "name")
    d = d.withColumn("formed", F.expr(whole))
    # card: 14 and 15 digits begin with two that tell the kind; the last digit makes the sum of Luhn's rule divisible by ten
    d = d.withColumn("kept", F.expr("if(length(regexp_replace(name, '[^0-9]', '')) < 16, 2, 1)"))
    d = d.withColumn("body", F.when(F.col("type") == "card", F.expr(f"concat(substr(name, 1, kept), substr(formed, kept + 1, length(formed) - kept - 1), {_more(key, 16, True)})")))
    d = d.withColumn("digits", F.expr("filter(split(body, ''), c -> c between '0' and '9')"))
    luhn = "aggregate(transform(digits, (c, i) -> if((i + size(digits)) % 2 = 1, if(int(c) * 2 > 9, int(c) * 2 - 9, int(c) * 2), int(c))), 0, (a, x) -> a + x)"
    card = F.expr(f"concat(body, cast(pmod(10 - pmod({luhn}, 10), 10) as string))")
    octets = [f"cast(1 + {_draw(key, 'o' + str(i), '254', str(i))} as string)" for i in range(4)]
    ip = F.expr(f"concat_ws('.', {', '.join(octets)}, nullif({_more(key, 16, True)}, ''))")
    # phone: a number that begins with 0 or 1 doesn't exist in this form; the country code stays
    code = r"regexp_extract(name, '^(?:\\+(?:\\d{1,3}(?=[ .(-])|[17]|\\d{2})[ .-]?)?', 0)"
    d = d.withColumn("code", F.expr(code))
    local = rf"regexp_replace(substr(formed, 1 + length(code)), '^(\\(?)[01]', concat('$1', cast(2 + {_draw(key, 'p', '8', '0')} as string)))"
    phone = F.expr(rf"concat(code, regexp_replace({local}, '^(\\d{{3}})[01](?=\\d{{6}}$)', concat('$1', cast(2 + {_draw(key, 'q', '8', '0')} as string))), {_more(key, 16, True)})")
    email = F.expr(f"concat(substring_index(formed, '@', 1), {_more(key, 4, False)}, '@', {_host(key)})")
    title = F.regexp_extract("name", r"^(\p{L}+\.? )", 1)
    d = d.withColumn("title", title).withColumn("last", F.expr("substr(name, length(title) + 1)"))
    cyrillic = F.col("name").rlike(r"\p{IsCyrillic}")
    # one name of the list; from the fourth attempt on two, and so on
    pick = lambda names: F.expr(f"array_join(transform(sequence(0, int(attempt / 4)), k -> element_at({_quoted(names)}, int({_draw(key, 'g', str(len(names)), 'k')}) + 1)), '-')")
    d = d.withColumn("longer", F.expr("concat(name, repeat(substr(name, -1, 1), int(attempt / 4)))"))
    given = (
        F.when((F.col("type") == "given_m") & cyrillic, pick(MALE_CYRILLIC)).when((F.col("type") == "given_f") & cyrillic, pick(FEMALE_CYRILLIC))
        .when(F.col("type") == "given_m", pick(MALE_LATIN)).when(F.col("type") == "given_f", pick(FEMALE_LATIN))
        .otherwise(F.expr(_by_form(key, "n", "longer")))
    )
    # the letter before the last is repeated and drawn with the others
    d = d.withColumn("stem", F.expr("concat(substr(last, 1, greatest(length(last) - 1, 1)), repeat(substr(last, greatest(length(last) - 1, 1), 1), int(attempt / 4)))"))
    grown = F.expr(f"concat({_by_form(key, 'l', 'stem')}, if(length(last) > 1, substr(last, -1, 1), ''))")
    person = F.concat("title", grown)
    made = F.when(F.col("type") == "card", card).when(F.col("type") == "ip", ip).when(F.col("type") == "phone", phone).when(F.col("type") == "email", email).when(F.col("type") == "person", person).when(F.col("type").startswith("given"), given).otherwise(F.expr(f"concat(formed, {_more(key, 16, True)})"))
    return d.select("type", "name", "attempt", made.alias("surrogate"))


def _host(key: str) -> str:
    """SQL for the host of an e-mail address with its labels but the last replaced by form."""
    host = "substring_index(name, '@', -1)"
    front = f"substr({host}, 1, length({host}) - length(substring_index({host}, '.', -1)))"
    return f"concat({_by_form(key, 'h', front)}, substring_index({host}, '.', -1))"


def distinct_surrogates(names: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(type, name, surrogate) of (type, name) rows: no two of a type with an equal surrogate, none that is a name.

    A given name may become one that others have, but not itself: its surname
    keeps the whole name apart from real ones.

    Each round draws again for those in a collision but the first, until there
    are none; a round looks at the whole table, which has one row per distinct
    entity, and the number of rounds follows the fullness of the smallest form.
    """
    names = scratch.save(names.distinct(), "names")
    table = scratch.save(surrogates(names.withColumn("attempt", F.lit(0)), key), "map0")
    k = 0
    while True:
        kind = F.regexp_extract("type", "^[a-z]+", 0)
        taken = table.groupBy(kind.alias("kind"), "surrogate").agg(F.min(F.struct("attempt", "name", "type")).alias("first"), F.count("*").alias("n"), F.max(F.col("surrogate") == F.col("name")).alias("same"))
        real = names.where("type not like 'given%'").select(F.col("type").alias("kind"), F.col("name").alias("surrogate"), F.lit(True).alias("real"))
        # a surrogate held twice goes to the entity drawn first; one that is a real entity to none
        bad = taken.join(real, ["kind", "surrogate"], "left").where("n > 1 or real or same")
        bad = table.withColumn("kind", kind).join(bad, ["kind", "surrogate"]).where("real or surrogate = name or attempt > first.attempt or name > first.name or type > first.type").select("type", "name", "attempt")
        bad = scratch.save(bad, f"bad{k}")
        if bad.isEmpty():
            return table
        again = surrogates(bad.withColumn("attempt", F.col("attempt") + 1), key)
        keep = table.join(bad.select("type", "name"), ["type", "name"], "left_anti")
        k += 1
        table = scratch.save(keep.unionByName(again), f"map{k}")


def _person_parts(each: DataFrame) -> DataFrame:
    """``each`` with title, given, name (the surname of persons) and tail, which joined are the entity."""
    person = F.col("type") == "person"
    title = F.when(person, F.regexp_extract("entity", r"^(\p{L}+\.? )", 1)).otherwise("")
    each = each.withColumn("title", title).withColumn("rest", F.expr("substr(entity, length(title) + 1)"))
    each = each.withColumn("given", F.when(person & F.col("rest").contains(" "), F.substring_index("rest", " ", 1)).otherwise(""))
    each = each.withColumn("tail", F.when(person, F.regexp_extract("rest", "('s|['-]+)$", 0)).otherwise(""))
    last = F.expr("substr(rest, if(given = '', 1, length(given) + 2), length(rest) - length(tail) - if(given = '', 0, length(given) + 1))")
    return each.withColumn("name", F.when(person, last).when(F.col("type") == "email", F.lower("entity")).otherwise(F.col("entity"))).drop("rest")


def _distinct_parts(each: DataFrame) -> DataFrame:
    """(type, name) of all that is drawn for. A given name has one gender: that of the lists, or else of the titles that it stands after."""
    bare = F.regexp_replace(F.trim("title"), r"\.", "")
    given = each.where("given <> ''").groupBy(F.col("given").alias("name")).agg(F.max(bare.isin(*MALE_TITLES)).alias("m"), F.max(bare.isin(*FEMALE_TITLES)).alias("f"))
    male, female = F.col("name").isin(*MALE_LATIN, *MALE_CYRILLIC), F.col("name").isin(*FEMALE_LATIN, *FEMALE_CYRILLIC)
    kind = F.when(male, "given_m").when(female, "given_f").when(F.expr("m and not f"), "given_m").when(F.expr("f and not m"), "given_f").otherwise("given_n")
    return each.select("type", "name").distinct().unionByName(given.select(kind.alias("type"), "name"))


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "adfunnel") -> DataFrame:
    """``docs`` with entities replaced in the text, and n_<type> (long) per type.

    E-mail addresses are compared without case. Names are drawn for by their
    parts, without the title; further mentions of a part in the same text, as a
    word in the same case, are replaced alike and are not counted. Texts without entities, empty
    and null texts stay as they are, with counts of 0. Ids may be null or
    repeated: rows are told apart by id and text, and rows that share both
    stay equal. Other columns are kept, also where they are called like
    columns used here. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.col(text_col)
    found = F.when(text.rlike(_MAY), F.regexp_extract_all(text, F.lit(f"({_ALL})"), F.lit(1)))
    kind = lambda e: reduce(lambda rest, t: F.when(e.rlike(f"^(?:{t[1]})$"), F.lit(t[0])).otherwise(rest), reversed(TYPES), F.lit("person"))
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), found.alias("found")).where("size(found) > 0")
    each = each.select("id", "t", F.posexplode("found").alias("i", "entity")).withColumn("type", kind(F.col("entity")))
    each = scratch.save(_person_parts(each), "entities")
    mapped = distinct_surrogates(_distinct_parts(each), key, scratch).select(F.regexp_extract("type", "^[a-z]+", 0).alias("kind"), F.col("name").alias("part"), "surrogate")
    # a person is drawn for by given name and surname
    units = F.expr("filter(array(struct(0 as k, 'given' as kind, given as part), struct(1 as k, type as kind, name as part)), u -> u.part <> '' or u.k = 1)")
    each = each.select("id", "t", "i", "type", "title", "tail", F.explode(units).alias("u")).select("id", "t", "i", "type", "title", "tail", "u.*").join(mapped, ["kind", "part"])
    whole = each.groupBy("id", "t", "i", "type", "title", "tail").agg(F.array_sort(F.collect_set(F.struct("k", "part", "surrogate"))).alias("units"))
    whole = whole.withColumn("surrogate", F.expr("concat(title, array_join(transform(units, u -> u.surrogate), ' '), tail)"))
    # names of one letter are no words to look for
    whole = whole.withColumn("names", F.expr("if(type = 'person', filter(units, u -> length(u.part) > 1), slice(units, 1, 0))"))
    # as many as one text holds
    per_text = whole.groupBy("id", "t").agg(F.array_sort(F.collect_set(F.struct("i", "type", "surrogate"))).alias("new"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    per_text = per_text.withColumn("surnames", F.expr("map_from_entries(transform(filter(names, u -> u.k = 1), u -> struct(u.part, u.surrogate)))"))
    per_text = per_text.withColumn("given", F.expr("map_from_entries(transform(filter(names, u -> u.k = 0), u -> struct(u.part, u.surrogate)))"))
    # the longest first; parts are letters, marks, ' and -, which stand for themselves in a pattern
    longest = "array_join(transform(reverse(array_sort(transform(names, u -> struct(length(u.part) as n, u.part as part)))), x -> x.part), '|')"
    per_text = per_text.withColumn("again", F.when(F.size("names") > 0, F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.expr(longest), F.lit(r")(?![\p{L}\p{M}])")))).drop("names")
    per_text = per_text.withColumnsRenamed({"id": "n_id", "t": "n_t"})
    # the row as it came, apart from columns made here
    out = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    out = out.join(per_text, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("t") == F.col("n_t")), "left")
    out = out.withColumn("parts", F.when(F.col("new").isNotNull(), F.split("text", f"(?:{_ALL})", -1)))
    mentions = "transform(regexp_extract_all(p, again, 0), w -> coalesce(try_element_at(surnames, w), try_element_at(given, w)))"
    put = f"array_join(zip_with(split(p, again, -1), {mentions}, (x, w) -> concat(x, coalesce(w, ''))), '')"
    out = out.withColumn("parts", F.expr(f"if(again is null, parts, transform(parts, p -> {put}))"))
    joined = F.expr("array_join(transform(parts, (p, i) -> concat(p, if(i < size(new), new[i].surrogate, ''))), '')")
    counts = [F.expr(f"if(new is null, 0L, bigint(size(filter(new, e -> e.type = '{t}'))))").alias(f"n_{t}") for t, _ in TYPES]
    made = {f"n_{t}" for t, _ in TYPES}
    text = F.when(F.col("new").isNull(), F.col("text")).otherwise(joined)
    kept = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in made]
    return out.select(*kept, *counts)
