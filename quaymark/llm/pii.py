"""Personal data: keyed, type-consistent surrogates, in DataFrame functions only.

One pattern finds e-mail and IPv4 addresses, payment cards, IBANs, social-security and phone numbers, named secrets, access
keys and titled names; a name found so is also replaced where the same text has it, or its given or family name alone,
without a title and in other capitals. Each distinct entity,
in a canonical form, gets a surrogate from a keyed digest: digits for digits and letters for letters in the same places,
country codes and card networks kept, octets of as many digits, names of the title's gender in the name's script, given and
family names each by themselves. Check digits of cards and IBANs that were valid are valid again. The surrogate is then
written in the occurrence's own format, so one entity has one surrogate everywhere. Rounds of checks give a new surrogate
to every entity but one of those that would share one, and to any whose surrogate is a real entity, until none is left.

The pattern goes over the texts once; what it finds is written beside them to the shared folder and used from there.

Defined results: null and empty texts stay as they are; long texts are read whole; repeated rows are replaced alike; null
doc_ids are no obstacle; an empty table gives no rows; other columns pass through, whatever their names, and the two that
are added get underscores after their names where the table has such columns already.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table, written

# Alternatives begin with what fails soonest, as most places of a text begin none of them.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])"
_CARD = r"[3-6](?<![0-9].)[0-9]{3}(?:[ \-]?[0-9]{4}){3}(?![0-9])"
_IBAN = r"[A-Z]{2}[0-9]{2}(?<![A-Za-z0-9].{4})(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SSN = r"[0-9]{3}-(?<![0-9\-].{4})[0-9]{2}-[0-9]{4}(?![0-9\-])"
_PHONE = r"(?=[+(0-9])(?<![0-9A-Za-z+])(?:\+?[0-9]{1,3}[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?=[0-9])(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_LABEL = r"(?i:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_SECRET = rf"(?=[PpTtSsAa])(?<![A-Za-z0-9]){_LABEL}(?=[A-Za-z_+/=.\-]{{0,64}}[0-9])[A-Za-z0-9_+/=\-][A-Za-z0-9_+/=.\-]{{6,}}[A-Za-z0-9_+/=\-]"
_KEY = r"A(?:KIA|SIA)(?<![A-Za-z0-9].{4})[0-9A-Z]{16}(?![A-Za-z0-9])"
_MALE, _FEMALE = r"Mr|Sir|Herr|Monsieur|Señor|Sr|Господин|Κύριος", r"Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
_ANY = r"Dr|Prof|Professor|Mx|Rev"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_ANY})\.? "
_STARTS = "".join(sorted({t[0] for t in f"{_MALE}|{_FEMALE}|{_ANY}".split("|")}))
_PARTICLES = r"(?: (?:de|da|di|do|dos|del|della|la|las|los|le|du|van|von|der|den|ter|zu|y|bin|ibn|al|el)){0,3}"
_NAME = rf"(?=[{_STARTS}])(?<![\p{{L}}]){_TITLE}\p{{Lu}}[\p{{L}}'’\-]{{1,30}}(?:{_PARTICLES} \p{{Lu}}[\p{{L}}'’\-]{{1,30}})?(?!\p{{L}})"
#: Kinds in the order in which they are looked for.
KINDS = {"email": _EMAIL, "card": _CARD, "iban": _IBAN, "ssn": _SSN, "phone": _PHONE, "ip": _IP, "secret": _SECRET, "key": _KEY, "name": _NAME}
PATTERN = "|".join(KINDS.values())
#: The session setting that names the key of surrogates, and the key that tests and registered queries take without one.
SETTING, TEST_KEY = "spark.quaymark.pii.key", "quaymark"
ROUNDS = 40


def _kind(m: Column) -> Column:
    tests = [(k, m.rlike(f"^(?:{p})$")) for k, p in KINDS.items()]
    out = F.when(tests[0][1], tests[0][0])
    for k, t in tests[1:]:
        out = out.when(t, k)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _canonical(kind: Column, m: Column) -> Column:
    male, female = m.rlike(rf"^(?:{_MALE})[. ]"), m.rlike(rf"^(?:{_FEMALE})[. ]")
    bare = F.regexp_replace(m, f"^{_TITLE}", "")
    script = F.when(bare.rlike(r"^\p{IsCyrillic}"), "c").when(bare.rlike(r"^\p{IsGreek}"), "g").otherwise("l")
    return (
        F.when(kind == "email", F.lower(m)).when(kind.isin("card", "ssn"), _digits(m)).when(kind == "phone", F.right(_digits(m), F.lit(10)))
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind == "secret", F.regexp_replace(m, f"^{_LABEL}", ""))
        .when(kind == "name", F.concat(F.when(male, "m").when(female, "f").otherwise("n"), script, F.lower(bare))).otherwise(m)
    )


def _numbers(seed: str, count: str) -> str:
    """SQL: an array of count numbers below 65536 from a keyed digest of seed."""
    digest = f"array_join(transform(sequence(0, ({count}) div 32), j -> sha2(concat_ws('|', secret, kind, {seed}, j), 512)), '')"
    return f"element_at(transform(array({digest}), d -> transform(sequence(0, {count}), i -> CAST(conv(substr(d, 4 * i + 1, 4), 16, 10) AS INT))), 1)"


def _scramble(value: str, seed: str) -> str:
    """SQL: value with digits, letters and hex digits replaced in place."""
    one = (
        "CASE WHEN hex THEN substr('0123456789abcdef', n[i - 1] % 16 + 1, 1) WHEN c RLIKE '[0-9]' THEN chr(48 + n[i - 1] % 10) WHEN c RLIKE '[a-z]' THEN chr(97 + n[i - 1] % 26)"
        " WHEN c RLIKE '[A-Z]' THEN chr(65 + n[i - 1] % 26) WHEN c RLIKE '\\\\p{L}' THEN chr(97 + n[i - 1] % 26) ELSE c END"
    )
    chars = f"transform(sequence(1, greatest(length({value}), 1)), i -> element_at(transform(array(substr({value}, i, 1)), c -> {one}), 1))"
    return f"element_at(transform(array({_numbers(seed, f'length({value})')}), n -> element_at(transform(array({value} RLIKE '^(?=[0-9]*[a-f])[0-9a-f]{{8,}}$'), hex -> array_join({chars}, '')), 1)), 1)"


def _luhn(body: str) -> str:
    """SQL: the check digit after body."""
    d = f"try_cast(substr({body}, i, 1) AS INT)"
    return f"CAST(pmod(-aggregate(transform(sequence(1, length({body})), i -> IF((length({body}) - i) % 2 = 0, IF({d} > 4, 2 * {d} - 9, 2 * {d}), {d})), 0, (a, x) -> a + x), 10) AS STRING)"


def _remainder(text: str) -> str:
    """SQL: text modulo 97, each letter standing for two digits, A for 10."""
    return f"aggregate(transform(sequence(1, length({text})), i -> substr({text}, i, 1)), 0L, (a, c) -> IF(c RLIKE '[0-9]', a * 10 + ascii(c) - 48, a * 100 + ascii(c) - 55) % 97)"


_ONSETS = {"l": "bdfghklmnprstvz", "c": "бвгдклмнпрст", "g": "βγδκλμνπρστ"}
_VOWELS = {"l": "aeiou", "c": "аеиоу", "g": "αεηιο"}
_ENDS = {"ml": ["us", "er", "on", "el"], "fl": ["a", "ina", "elle", "ia"], "nl": ["y", "en", "is", "in"], "mc": ["ов", "ин"], "fc": ["ова", "ина"], "nc": ["ко", "их"], "mg": ["ος", "ης"], "fg": ["α", "η"], "ng": ["ου", "ι"]}


def _coined(token: str, seed: str) -> str:
    """SQL: a new name of the gender and script that norm's first letters state, for one part of a name."""
    pick = lambda items, n: f"element_at(array({', '.join(repr(x) for x in items)}), {n} % {len(items)} + 1)"
    by_script = lambda f: f"CASE substr(norm, 2, 1) WHEN 'c' THEN {f('c')} WHEN 'g' THEN {f('g')} ELSE {f('l')} END"
    syllable = lambda k: f"concat({by_script(lambda s: pick(_ONSETS[s], f'n[{2 * k}]'))}, {by_script(lambda s: pick(_VOWELS[s], f'n[{2 * k + 1}]'))})"
    last = by_script(lambda s: pick(_ONSETS[s], "n[6]"))
    end = "CASE substr(norm, 1, 2) " + " ".join(f"WHEN '{k}' THEN {pick(v, 'n[7]')}" for k, v in _ENDS.items()) + " END"
    return f"IF({token} = '', '', element_at(transform(array({_numbers(seed, '8')}), n -> concat({syllable(0)}, {syllable(1)}, {syllable(2)}, {last}, {end})), 1))"


def _surrogate(entities: DataFrame, secret: str) -> DataFrame:
    """entities (kind, norm, try) with ``alias``, the canonical surrogate of that try."""
    e = entities.withColumn("secret", F.lit(secret)).withColumn("seed", F.concat_ws("#", "norm", F.col("try").cast("string")))
    e = e.withColumn("part", F.when(F.col("kind") == "email", F.substring_index("norm", "@", 1)).when(F.col("kind") == "key", F.expr("substr(norm, 5)")).when(F.col("kind") == "iban", F.expr("substr(norm, 3)")).otherwise(F.col("norm")))
    e = e.withColumn("s", F.when(~F.col("kind").isin("ip", "given", "family"), F.expr(_scramble("part", "seed"))))
    domain = "substr(norm, instr(norm, '@') + 1)"
    e = e.withColumn("site", F.when(F.col("kind") == "email", F.expr(f"substr({domain}, 1, length({domain}) - length(substring_index({domain}, '.', -1)))")).otherwise(""))
    octets = f"element_at(transform(array({_numbers('seed', '4')}), n -> array_join(transform(split(norm, '[.]'), (o, i) -> CASE length(o) WHEN 1 THEN 1 + n[i] % 9 WHEN 2 THEN 10 + n[i] % 90 ELSE 100 + n[i] % 156 END), '.')), 1)"
    body = "concat(substr(norm, 1, 1), substr(s, 2, length(s) - 2))"
    card = f"concat({body}, IF({_luhn('substr(norm, 1, length(norm) - 1)')} = substr(norm, -1), {_luhn(body)}, substr(s, -1)))"
    rest = lambda account: f"concat({account}, substr(norm, 1, 2))"
    valid = f"{_remainder('concat(substr(norm, 5), substr(norm, 1, 4))')} = 1"
    digits = f"lpad(CAST(98 - {_remainder(rest('substr(s, 3)'))} * 3 % 97 AS STRING), 2, '0')"  # 100 is 3 modulo 97
    iban = f"concat(substr(norm, 1, 2), IF({valid}, {digits}, substr(s, 1, 2)), substr(s, 3))"
    lead = lambda i: f"translate(substr(s, {i}, 1), '01', '23')"
    alias = f"""CASE kind
      WHEN 'email' THEN concat(s, '@', {_scramble('site', 'site')}, substring_index(norm, '.', -1))
      WHEN 'ip' THEN {octets} WHEN 'card' THEN {card}
      WHEN 'given' THEN concat(substr(norm, 1, 2), {_coined('substr(norm, 3)', 'seed')})
      WHEN 'family' THEN concat(substr(norm, 1, 2), {_coined('substr(norm, 3)', f'concat_ws({chr(39)}#{chr(39)}, substr(norm, 2), try)')})
      WHEN 'phone' THEN concat({lead(1)}, substr(s, 2, 2), {lead(4)}, substr(s, 5)) WHEN 'ssn' THEN concat(translate(substr(s, 1, 1), '09', '12'), substr(s, 2))
      WHEN 'iban' THEN {iban} WHEN 'key' THEN concat(substr(norm, 1, 4), s) ELSE s END"""
    return e.withColumn("alias", F.expr(alias)).select("kind", "norm", "try", "alias")


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, alias) for distinct (kind, norm): aliases differ from each other and from every norm of their kind.

    The parts of names are such entities of their own, so a family keeps its name whoever of it is named.
    """
    named = entities.where("kind = 'name'").select("norm", *[F.expr(f"concat(substr(norm, 1, 2), {x})").alias(c) for c, x in (("given", "IF(norm LIKE '% %', substring_index(substr(norm, 3), ' ', 1), '')"), ("family", "substring_index(substr(norm, 3), ' ', -1)"))]).distinct()
    parts = named.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("norm")) for c in ("given", "family")])).alias("x")).select("x.kind", "x.norm").where("length(norm) > 2")
    held = _distinct(entities.where("kind != 'name'").select("kind", "norm").unionAll(parts), secret)
    of = lambda c: held.where(F.col("kind") == c).select(F.col("norm").alias(c), F.expr("substr(alias, 3)").alias(f"{c}_alias"))
    whole = named.join(of("given"), "given", "left").join(of("family"), "family", "left")
    names = whole.select(F.lit("name").alias("kind"), "norm", F.concat(F.substring("norm", 1, 2), F.concat_ws(" ", "given_alias", "family_alias")).alias("alias"))
    return held.where("kind NOT IN ('given', 'family')").unionAll(names)


def _distinct(entities: DataFrame, secret: str) -> DataFrame:
    real = cut(entities.distinct())
    held = cut(_surrogate(real.withColumn("try", F.lit(0)), secret))
    for _ in range(ROUNDS):
        shared = held.groupBy("kind", "alias").agg(F.count("*").alias("n"), F.min("norm").alias("first")).where("n > 1")
        again = held.join(shared, ["kind", "alias"]).where("norm != first").select("kind", "norm")
        again = again.unionAll(held.join(real.select("kind", F.col("norm").alias("alias")), ["kind", "alias"]).select("kind", "norm")).distinct()
        again = cut(again)
        if again.isEmpty():
            return held.select("kind", "norm", "alias")
        moved = _surrogate(held.join(again, ["kind", "norm"]).select("kind", "norm", (F.col("try") + 1).alias("try")), secret)
        held = cut(held.join(again, ["kind", "norm"], "left_anti").unionAll(moved))
    raise ValueError("there are more entities of some format than it can tell apart")


def _written() -> Column:
    """alias in the format of the occurrence m."""
    skip = "length(regexp_replace(m, '[^0-9]', '')) - length(alias)"
    filled = f"array_join(transform(split(m, ''), (c, i) -> IF(c RLIKE '[0-9]' AND length(regexp_replace(substr(m, 1, i + 1), '[^0-9]', '')) > {skip}, substr(alias, length(regexp_replace(substr(m, 1, i + 1), '[^0-9]', '')) - ({skip}), 1), c)), '')"
    spaced = "array_join(transform(split(m, ''), (c, i) -> IF(c = ' ', c, substr(alias, length(replace(substr(m, 1, i + 1), ' ', '')), 1))), '')"
    cased = "array_join(transform(split(m, ''), (c, i) -> IF(c RLIKE '[A-Z]', upper(substr(alias, i + 1, 1)), substr(alias, i + 1, 1))), '')"
    return F.expr(f"CASE WHEN kind IN ('card', 'ssn', 'phone') THEN {filled} WHEN kind = 'iban' THEN {spaced} WHEN kind = 'email' THEN {cased} WHEN kind = 'secret' THEN concat(substr(m, 1, length(m) - length(norm)), alias) WHEN kind = 'name' THEN concat(title, IF(substr(m, length(title) + 1) = upper(substr(m, length(title) + 1)), upper(substr(alias, 3)), initcap(substr(alias, 3)))) ELSE alias END")


def _mentions() -> Column:
    """Of a titled name m and what takes its place, w: (n, m, w) of the name without its title, of its given name and of its
    family name, as they stand, in capitals and with capitals first; n is minus the length, so that long ones come first."""
    bare, new = F.expr("substr(m, title + 1)"), F.expr("substr(w, title + 1)")
    end = lambda c, i: F.substring_index(c, " ", i)
    pairs = [(bare, new), (end(bare, 1), end(new, 1)), (end(bare, -1), end(new, -1))]
    forms = [lambda c: c, F.upper, F.initcap]
    return F.array(*[F.struct((-F.length(f(a))).alias("n"), f(a).alias("m"), f(b).alias("w")) for a, b in pairs for f in forms])


def _entity(df: DataFrame) -> DataFrame:
    df = df.withColumn("kind", _kind(F.col("m"))).withColumn("norm", _canonical(F.col("kind"), F.col("m")))
    return df.withColumn("title", F.regexp_extract("m", f"^{_TITLE}", 0))


def key(spark: SparkSession) -> str:
    """The session's key of surrogates; where it names none the test key, with a warning, as anyone can make the same ones."""
    found = spark.conf.get(SETTING, None)
    if not found:
        warnings.warn(f"{SETTING} is not set: surrogates are made with the test key", stacklevel=2)
    return found or TEST_KEY


def replace(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """docs with every entity in text_col replaced, and n_entities and entity_kinds (comma-joined) after its columns."""
    names, at = docs.columns, docs.columns.index(text_col)
    none = [k for k, (_, kind) in enumerate(docs.dtypes) if kind == "void"]  # no file can hold these
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if k != at and k not in none]
    read = docs.select(*others, F.col(f"`{text_col}`").cast("string").alias("t"))
    read = written(read.withColumn("found", F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0))))
    has = F.coalesce(F.size("found") > 0, F.lit(False))
    hit = cut(read.where(has).withColumn("rid", F.monotonically_increasing_id()))
    each = hit.select("rid", F.explode(F.array_distinct("found")).alias("m"))
    kinds = _entity(each.select("m").distinct())
    alias = surrogates(kinds, secret)
    ways = kinds.join(alias, ["kind", "norm"]).select("m", "kind", _written().alias("w"), F.when(F.col("kind") == "name", F.length("title")).alias("title"))
    own = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("title").isNotNull(), _mentions())))))
    of = each.join(ways, "m").groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("m", "w"))).alias("by"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), own.alias("named"))
    untitled = r"aggregate(named, p, (a, x) -> regexp_replace(a, concat('(?<!\\p{L})\\Q', x.m, '\\E(?!\\p{L})'), x.w))"  # longer names first
    pieces = F.split("t", PATTERN, -1)
    whole = F.expr(f"array_join(zip_with(pieces, found, (p, f) -> concat(IF(size(named) = 0, p, {untitled}), coalesce(element_at(by, f), ''))), '')")
    done = hit.join(of, "rid").withColumn("pieces", pieces).withColumn("new", whole)
    added = [fresh("n_entities", names), fresh("entity_kinds", names)]
    out = lambda text, n, k: [*[(text if i == at else F.lit(None) if i in none else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)], n.cast("long").alias(added[0]), k.alias(added[1])]
    return read.where(~has).select(*out(F.col("t"), F.lit(0), F.lit(""))).unionAll(done.select(*out(F.col("new"), F.size("found"), F.col("kinds"))))


def query(spark, sf_dir):
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key(spark))
