"""Surrogates for personal data, in DataFrame operations only.

1. One pattern finds emails, IPv4 addresses, phone numbers, payment cards (bare numbers with a valid check digit, or in
   groups), social security numbers, secrets, access keys and names with a title. A mention's kind and normal form make an entity: letter case, blanks and separators don't
   matter, so mentions of one entity in any document and format are one.
2. Each distinct entity of the corpus draws a surrogate from a stream keyed by a secret: letters by letters of the
   same script and case, digits by digits, a card with a valid check digit by another valid one, a phone number by one of the same country, given
   names and surnames, each on their own, by such of the same gender and script. Entities whose draws collide, with each other or with a real entity, draw again, all
   but the least of them, until none do: distinct entities keep distinct surrogates.
3. Texts with mentions fetch the surrogates of their own entities by a join on the text's hash, and each mention is
   written in the format it had.

Defined results: null texts stay null, empty and clean texts stay as they are; texts of any length are read whole;
equal mentions get equal surrogates everywhere; repeated rows stay repeated; null keys are kept; an empty table gives an
empty one. All columns are carried, whatever their names; only the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise

#: A word of a name, with hyphens, apostrophes (but not those of 's and such) and inner capitals, or an initial; academic
#: titles, and particles that stand before a word.
_WORD = r"(?:(?:Dr|Prof|\p{Lu})\.|\p{Lu}[\p{L}\p{M}]+(?:-\p{L}[\p{L}\p{M}]*|['’](?!(?:s|d|m|t|ll|re|ve)(?![\p{L}]))\p{L}[\p{L}\p{M}]*)*|\p{Lu}['’]\p{L}[\p{L}\p{M}]*(?:[-'’]\p{Lu}[\p{L}\p{M}]*)*)"
_PARTICLE = r"(?:(?:von|van|zu|de|del|della|di|da|dos|du|bin|ibn|ben|al|el|ter|ten)(?: (?:der|den|dem|la|las|los|le))? )"
#: Forms of personal data. Each is one alternative of the pattern; none matches an empty string.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w]|[.-]\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|(?:1[ .-])?(?:\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})|8[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}-\d{2}-\d{2}|[679]\d{2}(?: \d{2}){3}"
    # national forms begin with 0; eight digits in twos and four are a date
    r"|(?=\(?0(?:[ ().\/-]{0,2}\d){7,14}(?!\d))(?!\d{1,2}(?<dot>[.\/-])\d{1,2}\k<dot>\d{2,4}(?!\d|[ .\/-]\d))(?:\(0\d{1,5}\)|0\d{1,5}(?:[ ]?\/)?)[ .-]?\d{1,11}(?:[ .-]\d{1,8}){0,5})(?![\w]|[.-]\d)",
    "secret": r"(?<![\p{L}])(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|passwd|pwd|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey)\s{0,3}[=:]\s{0,3}[\"']?(?=[_/+.-]*[A-Za-z0-9])[A-Za-z0-9_/+.-]{8,}",
    "access_key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pos]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-(?=-*[A-Za-z0-9])[A-Za-z0-9-]{10,})(?![A-Za-z0-9_-])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа)\.?(?: " + _PARTICLE + "?" + _WORD + ")+",
}
PATTERN = "|".join(PATTERNS.values())
#: What every form has one of, so that most texts needn't be searched by the pattern: a sign, or a part of a title or key.
SIGNS, TITLES = "[0-9@=:]", ("Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Госп", "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "xox")

#: Titles of women; all others of the pattern are of men.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
#: Given names by gender and script, and syllables of surnames by script.
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Ida Julia Laura Lena Maria Nora Olivia Paula Rosa Sara Sofia Teresa Vera".split(),
    ("m", "latin"): "Adam Bruno Carl David Felix Hugo Ivan Jonas Leo Marco Max Oscar Paul Simon Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Ольга Софья".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Иван Максим Олег Павел Роман".split(),
}
SYLLABLES = {"latin": "ba den do fer ga hol ka len mar nel or pe ro san ter vin".split(), "cyrillic": "ба ва го да ле ма не ро са та ви ко ле ни по ру".split()}
#: Letters that stand for each other, by script and case.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâãäåæçèéêëìíîïñòóôõöùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ")

STREAM = 128  # numbers of a surrogate's stream; longer entities use it again
WIDER = 8  # the draw from which more changes than an entity's form lets: few surrogates of that form are left
ROUNDS = 64  # of draws, until it's an error that entities have no surrogate


def mentions(text: Column) -> Column:
    """All mentions of a text, in order; null if there can't be any."""
    likely = text.rlike(SIGNS)
    for title in TITLES:
        likely |= text.contains(title)
    return F.when(likely, F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)))


#: What stands before the value of a secret, and the part of an access key that tells its kind.
_PREFIX = r"^(AKIA|ASIA|gh[pos]_|sk-|xox[abp]-)"
_LABEL = r"^[\p{L}_-]+\s{0,3}[=:]\s{0,3}[\"']?"


def kind_of(mention: Column) -> Column:
    """The kind of a mention, from its own form."""
    kind = F.when(mention.rlike(_PREFIX + r"[A-Za-z0-9-]{10,}$"), "access_key").when(mention.rlike(_LABEL), "secret").when(mention.contains("@"), "email")
    kind = kind.when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    kind = kind.when(mention.rlike(r"^(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})$"), "card")
    return kind.when(mention.rlike(r"^[+(\d]"), "phone").otherwise("name")  # all other numbers of the pattern, names begin with a title


def is_private(mention: Column) -> Column:
    """Whether a mention is personal data: bare numbers are cards only with a valid check digit."""
    bare = mention.rlike(r"^\d{13,19}$")
    return ~bare | (_check_digit(F.substr(mention, F.lit(1), F.length(mention) - 1)) == F.right(mention, F.lit(1)))


def entities_of(mention: Column) -> Column:
    """The entities of a mention, each as kind:normal form. A name is a given name, if it has one, and a surname, so that who is
    met by surname alone later is met again; a phone number with a country code keeps it, but 1 and ten digits are those ten."""

    def normal(kind: Column) -> Column:
        digits = F.regexp_replace(mention, r"\D", "")
        abroad = F.when(mention.startswith("+"), digits).when(digits.startswith("00"), F.substr(digits, F.lit(3)))
        phone = F.when(F.coalesce(abroad, digits).rlike(r"^1\d{10}$"), F.right(digits, F.lit(10))).otherwise(F.coalesce(F.concat(F.lit("+"), abroad), digits))
        form = F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", phone)
        return F.concat_ws(":", kind, form.otherwise(F.regexp_replace(mention, _LABEL, "")))

    gender = F.when(F.regexp_extract(mention, r"^(\p{L}+)", 1).isin(*FEMALE_TITLES), "f").otherwise("m")
    words = F.regexp_replace(mention, r"^\p{L}+\.? ", "")
    given = F.regexp_extract(words, f"^(.*?) (?:{_PARTICLE}?\\S+)$", 1)
    surname = F.when(given == "", words).otherwise(F.substr(words, F.length(given) + 2))
    named = F.filter(F.array(F.when(given != "", F.concat_ws(":", F.lit("given"), gender, given)), F.concat_ws(":", F.lit("surname"), gender, surname)), lambda x: x.isNotNull())
    return let(kind_of(mention), lambda kind: F.when(kind == "name", named).otherwise(F.array(normal(kind))))


def stream(entity: Column, key: str, attempt: Column) -> Column:
    """STREAM bytes in hex, from the secret key, an entity and the number of the draw."""
    seed = F.concat_ws("|", F.lit(key), entity, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat_ws("|", F.sha2(seed, 256), F.lit(str(i))), 256) for i in range(STREAM // 32)])


def draw(bits: Column, i: Column) -> Column:
    """The i-th number of a stream, 0 to 255."""
    return F.conv(F.substr(bits, F.pmod(i, F.lit(STREAM)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def disguise(word: Column, bits: Column, shift: int = 0) -> Column:
    """Each letter and digit of word by one of the same script and case; other signs stay."""

    def one(c: Column, i: Column) -> Column:
        n = draw(bits, i + shift)
        out = c
        for letters in reversed(ALPHABETS):
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(word, ""), one), "")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)


def _luhn_sum(digits: Column) -> Column:
    """Of a number still without its check digit, right to left with the last doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def surrogate(entity: Column, key: str, attempt: Column) -> Column:
    """What stands for an entity, in its normal form."""
    kind, form = F.substring_index(entity, ":", 1), F.substr(entity, F.locate(":", entity) + 1)
    wider = attempt >= WIDER

    def any_sign(word: Column, bits: Column) -> Column:
        """In later draws signs change too."""
        return disguise(F.when(wider, F.regexp_replace(word, r"[^A-Za-z0-9]", "x")).otherwise(word), bits)

    def of(bits: Column) -> Column:
        user, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
        ends = F.when(domain.endswith(".org"), "org").when(domain.endswith(".net"), "net").otherwise("com")
        more = F.when(wider, disguise(F.lit("00000000"), bits, 32)).otherwise("")  # a later draw is longer
        email = F.concat(disguise(user, bits), more, F.lit("@"), disguise(F.regexp_extract(domain, r"^([^.]+)", 1), bits, 64), F.lit(".example."), ends)
        octets = [draw(bits, F.lit(i)).cast("string") for i in range(1, 4)]
        ip = F.concat_ws(".", (draw(bits, F.lit(0)) % 223 + 1).cast("string"), *octets)

        def card(body: Column) -> Column:
            valid = F.right(form, F.lit(1)) == _check_digit(F.substr(form, F.lit(1), F.length(form) - 1))
            # an invalid number gets a check digit that is wrong by as much
            return F.concat(body, F.when(valid, _check_digit(body)).otherwise(((_check_digit(body).cast("int") + F.right(form, F.lit(1)).cast("int") - _check_digit(F.substr(form, F.lit(1), F.length(form) - 1)).cast("int") + 10) % 10).cast("string")))

        # the first digit of a card names its network and stays
        body = F.concat(F.left(form, F.lit(1)), disguise(F.substr(form, F.lit(2), F.length(form) - 2), bits))
        hexed = F.array_join(F.transform(F.split(form, ""), lambda c, i: _pick(list("0123456789abcdef"), draw(bits, i))), "")
        cyrillic, female = form.rlike(r"\p{IsCyrillic}"), form.startswith("f")

        def name(script: str) -> Column:
            given = F.when(female, _pick(GIVEN["f", script], draw(bits, F.lit(1)))).otherwise(_pick(GIVEN["m", script], draw(bits, F.lit(1))))
            surname = F.initcap(F.concat(*[_pick(SYLLABLES[script], draw(bits, F.lit(i))) for i in range(2, 5)]))
            more = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), attempt), 2, 8), lambda i: _pick(SYLLABLES[script], draw(bits, i + 8))), "")  # a later draw is longer
            return F.concat(F.substr(form, F.lit(1), F.lit(2)), F.when(kind == "given", given).otherwise(surname), more)

        out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", let(body, card))
        prefix = F.regexp_extract(form, _PREFIX, 1)
        out = out.when(kind == "access_key", F.concat(prefix, any_sign(F.substr(form, F.length(prefix) + 1), bits)))
        out = out.when((kind == "phone") & form.startswith("+"), F.concat(F.substr(form, F.lit(1), F.lit(3)), disguise(F.substr(form, F.lit(4)), bits, 1), more))
        out = out.when(kind == "phone", F.concat(F.when(form.startswith("0"), "0").otherwise((draw(bits, F.lit(0)) % 8 + 2).cast("string")), disguise(F.substr(form, F.lit(2)), bits, 1), more))
        out = out.when(kind == "ssn", disguise(form, bits)).when(kind.isin("given", "surname"), F.when(cyrillic, name("cyrillic")).otherwise(name("latin")))
        return F.concat_ws(":", kind, out.when(form.rlike("^[0-9a-f]+$"), hexed).otherwise(any_sign(form, bits)))

    return let(stream(entity, key, attempt), of)


def render(mention: Column, stand_in: Column) -> Column:
    """A surrogate in the format that the mention had. That of a name is name: and its words."""
    kind, form = F.substring_index(stand_in, ":", 1), F.substr(stand_in, F.locate(":", stand_in) + 1)
    form = F.when(kind == "phone", F.ltrim(form, F.lit("+"))).otherwise(form)
    n, total = F.length(form), F.length(F.regexp_replace(mention, r"\D", ""))
    extra = F.greatest(n - total, F.lit(0))  # a later draw is longer: its last digits follow

    def digit(c: Column, i: Column) -> Column:
        at = n - extra - total + F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), r"\D", ""))  # digits before the surrogate's own stay
        return F.when(c.rlike(r"\d") & (at > 0), F.substr(form, at, F.lit(1))).otherwise(c)

    digits = F.concat(F.array_join(F.transform(F.split(mention, ""), digit), ""), F.substr(form, n - extra + 1))
    name = F.concat(F.regexp_extract(mention, r"^(\p{L}+\.? )", 1), form)
    label = F.regexp_extract(mention, f"({_LABEL})", 1)
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "name", name).when(kind == "secret", F.concat(label, form)).when((kind == "email") & upper, F.upper(form)).otherwise(form)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate) for the distinct entities, without collisions among surrogates or with entities."""
    entities = materialise(entities, "entities")
    waiting, settled = entities.withColumn("attempt", F.lit(0)), None
    for _ in range(ROUNDS):
        drawn = waiting.withColumn("surrogate", surrogate(F.col("entity"), key, F.col("attempt")))
        real = entities.select(F.col("entity").alias("surrogate"), F.lit(True).alias("_real"))
        drawn = drawn.join(real, "surrogate", "left")
        if settled is not None:
            drawn = drawn.join(settled.select("surrogate", F.lit(True).alias("_taken")), "surrogate", "left")
        else:
            drawn = drawn.withColumn("_taken", F.lit(None).cast("boolean"))
        first = F.min("entity").over(Window.partitionBy("surrogate"))
        drawn = materialise(drawn.withColumn("_won", F.col("_real").isNull() & F.col("_taken").isNull() & (F.col("entity") == first)).select("entity", "attempt", "surrogate", "_won"), "drawn")
        won = drawn.filter("_won").select("entity", "surrogate")
        settled = won if settled is None else settled.unionByName(won)
        waiting = drawn.filter("not _won").select("entity", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return settled
    kinds = waiting.groupBy(F.substring_index("entity", ":", 1).alias("kind")).count().collect()  # a row per kind
    raise ValueError(f"no surrogates of their own after {ROUNDS} draws: {', '.join(f'{r['count']} of kind {r['kind']}' for r in kinds)}")


def replace_private(df: DataFrame, text: str = "text", key: str = "corpus") -> DataFrame:
    """df with surrogates in its text. key is the secret: another one gives other surrogates."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    found = df.select(row, F.col(f"`{text}`").alias("_text")).withColumn("_found", mentions(F.col("_text"))).withColumn("_private", F.filter("_found", is_private))
    clean = found.filter("_private is null or size(_private) = 0").select("_row.*")

    hit = found.filter("size(_private) > 0").withColumn("_id", F.md5("_text"))
    per_text = hit.select("_id", F.explode(F.array_distinct("_private")).alias("mention")).distinct()
    per_text = materialise(per_text.select("_id", "mention", F.posexplode(entities_of(F.col("mention"))).alias("at", "entity")), "mentions")
    table = assign(per_text.select("entity").distinct(), key)
    parts = per_text.join(table, "entity").groupBy("_id", "mention").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("s"))
    words = F.array_join(F.transform("s", lambda x: F.substring_index(x, ":", -1)), " ")
    stand_in = F.when(F.element_at("s", 1).rlike("^(given|surname):"), F.concat(F.lit("name:"), words)).otherwise(F.element_at("s", 1))
    rendered = parts.select("_id", "mention", render(F.col("mention"), stand_in).alias("stand_in"))
    own = rendered.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("mention", "stand_in"))).alias("_map"))

    gaps = F.split(F.col("_text"), PATTERN, -1)
    stand_ins = F.transform("_found", lambda m: F.coalesce(F.try_element_at(F.col("_map"), m), m))
    new = let(gaps, lambda g: F.concat(F.array_join(F.zip_with(F.slice(g, 1, F.size("_found")), stand_ins, lambda a, b: F.concat(a, b)), ""), F.element_at(g, -1)))
    done = hit.join(own, "_id").withColumn("_new", new).select(*[(F.col("_new") if c == text else F.col("_row").getField(c)).alias(c) for c in df.columns])
    return clean.unionByName(done)
