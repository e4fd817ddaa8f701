"""PII: surrogates for detected entities, in DataFrame functions only.

What is found, each of any length unless its format has one:

- e-mail addresses, also with letters beyond ASCII; IPv4 addresses; IPv6 addresses with a digit, in full or with ``::``;
- phone numbers with a country code, ``555-123-4567`` and the like, and national ones with a leading 0 (``0171 2345678``, ``01 23 45 67 89``);
- card numbers of 13 to 19 digits, plain or in their usual groups; IBANs; US social security numbers with hyphens;
- secrets: AWS key ids, ``ghp_``, ``gho_``, ``sk_``, ``pk_`` keys (or with a hyphen), JSON web tokens, 32 and more lower-case hexadecimal
  digits (not all the same), and 6 or more characters without blanks or quotes given with ``=`` or ``:`` to password, passwd, pwd, secret, token, api_key, access_key;
- names after one or more titles: all words with a capital that follow, the last as the surname. Names without a title are not found.

Every entity gets a keyed surrogate of its type: digits become digits, letters letters of the same script and case, signs stay; a card
keeps its first digit and its valid check digit, an IBAN its country and valid check digits, a phone number its country code or
leading 0, an e-mail address its top-level domain and equal domains stay equal; names follow the script, and the gender
of the titles that a first name has in the corpus (neutral names stand in for first names that have both or none).

Spellings of one entity (separators, case) share a canonical form, hence a surrogate, in all documents; a first name
and a surname have one surrogate each, whatever the title. All surrogates of a type are checked: where two
entities would get the same one, or one that is itself an entity of the corpus, all but one try again with the next
attempt number, until none is left. So different entities stay different. Names, addresses and secrets get longer with further
attempts, so there are always enough; a format of fixed length that the corpus exhausts raises after many attempts.

Only texts with findings are shuffled, once; a finding is a row that is joined with its entities' surrogates, under
several keys for one entity, as it may be frequent. Null texts stay null, texts without
findings are unchanged, repeated rows get equal results; the work grows with the length of a text. ``n_chars``, if there is such a column, follows the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import stored, unwrapped, wrapped

# Titles and the names that stand in for others, by gender (m, f, n) and script.
TITLES = {
    "m": "Mr|MR|Sir|Lord|Herr|Señor|Monsieur|Signor|Господин|г-н|Κύριος",
    "f": "Mrs|MRS|Ms|Miss|Lady|Frau|Señora|Madame|Signora|Госпожа|г-жа|Κυρία",
    "n": "Dr|DR|Prof|PROF",
}
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Tom Victor",
    ("f", "latin"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tina Vera",
    ("n", "latin"): "Alex Andrea Chris Dana Jamie Kim Lee Luca Nicola Noa Robin Sam Sascha Toni Yael",
    ("m", "cyrillic"): "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Юрий",
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Полина Раиса Юлия",
    ("n", "cyrillic"): "Женя Саша Валя Шура Слава",
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Μιχάλης Νίκος Πέτρος Σπύρος",
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Νίκη Σοφία",
    ("n", "greek"): "Χάρις Φώτης",
}
SYLLABLES = {
    "latin": "ba den fer gon hal kim lor mar nel pas ros tan vel win zor",
    "cyrillic": "бар ден фер гон хал ким лор мар нел пас рос тан вел зор",
    "greek": "βαρ δεν φερ γον χαλ κιμ λορ μαρ νελ πας ρος ταν ζορ",
}

# Possessive quantifiers (++, *+) keep the matching linear and free of recursion, however long a text is.
_TITLE = "|".join(TITLES.values())
_TITLED = rf"(?:(?:{_TITLE})\.? )++"
_NAME = r"\p{Lu}(?:[\p{L}\-]|[’'](?=\p{Lu}))++"
_ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api_?key|access_?key)[\"']?\s*+[=:]\s*+[\"']?"
_SECRET = (
    r"AKIA[0-9A-Z]{16,}+|(?:ghp|gho|sk|pk)[_\-][A-Za-z0-9_\-]{16,}+"
    r"|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]*+"
)
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
_IPV6 = rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)"
PATTERN = "|".join(
    [
        r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}.\-]*[\p{L}\p{N}\-]\.\p{L}{2,}+",
        rf"(?<![A-Za-z0-9]){_ASSIGNED}[^\s\"']{{6,}}+",
        rf"(?<![A-Za-z0-9])(?:{_SECRET})(?![A-Za-z0-9])",
        # A run of one and the same character is no secret.
        r"(?<![A-Za-z0-9])(?!([a-f])\1++(?![A-Za-z0-9]))(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
        rf"(?<![\p{{L}}\p{{N}}:])(?=[A-Fa-f:]*[0-9]){_IPV6}(?![\p{{L}}\p{{N}}:])",
        r"(?<![0-9])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])",
        r"(?<![0-9A-Za-z\-])\(?[0-9]{3}\)?[ .\-][0-9]{3}[.\-][0-9]{4}(?![0-9\-])",
        r"(?<![0-9A-Za-z.\-])0[0-9]{2,4}[ /\-][0-9]{5,8}(?![0-9\-])",
        r"(?<![0-9A-Za-z.\-])0[0-9](?:[ .][0-9]{2}){4}(?![0-9]|[.\-][0-9])",
        r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
        r"(?<![0-9\-])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![0-9])",
        # Any number of titles and words; a title before a further name begins the next finding.
        rf"\b(?=(?:{_TITLE})\.? )(?<!(?:{_TITLE})\.? ){_TITLED}{_NAME}(?: (?!(?:{_TITLE})\.? \p{{Lu}}){_NAME})*+",
    ]
)
# What a text must hold for any of the patterns to match, apart from digits, addresses and titles; lower-case.
_MARKS = "akia ghp_ ghp- gho_ gho- sk_ sk- pk_ pk- eyj password passwd pwd secret token apikey api_key accesskey access_key".split()
#: Entities are joined under so many keys each.
SALTS = 8


def _may_match(text: Column) -> Column:
    """A cheap first look, mostly plain searches: texts that fail it have no finding. Secrets may consist of letters only."""
    lowered = F.lower(text)
    looks = [text.rlike("[0-9@]"), *[lowered.contains(mark) for mark in _MARKS], text.rlike("[a-f]{32}")]
    titled = [text.contains(title) for title in _TITLE.split("|")]
    any_of = lambda columns: reduce(Column.__or__, columns)
    return any_of(looks) | (any_of(titled) & text.rlike(rf"(?:{_TITLE})\.? \p{{Lu}}"))


def _kind(x: Column) -> Column:
    return (
        F.when(x.rlike(rf"^(?:{_TITLE})\.? \p{{Lu}}"), "name")
        .when(x.rlike(rf"^{_ASSIGNED}|^(?:{_SECRET})$|^(?=[0-9a-f]*[a-f])[0-9a-f]{{32,}}$"), "secret")
        .when(x.contains("@"), "email")
        .when(x.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(x.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ipv4")
        .when(x.contains(":"), "ipv6")
        .when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(x.rlike(r"^(?:\+|\(|[0-9]{3}[ .\-]|0[0-9]{1,4}[ ./\-](?![0-9]{4}[ \-][0-9]{4}|[0-9]{6}[ \-]))"), "phone")
        .otherwise("card")
    )


def _prefix(x: Column) -> Column:
    """What of a finding is no part of the entity: a title, or what the value is given to."""
    return F.regexp_extract(x, rf"^(?:{_ASSIGNED}|{_TITLED})", 0)


def _core(x: Column) -> Column:
    return F.regexp_replace(x, rf"^(?:{_ASSIGNED}|{_TITLED})", "")


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _gender(prefix: Column) -> Column:
    """Of the titles: m, f or null."""
    return F.when(prefix.rlike(rf"(?:^| )(?:{TITLES['m']})\.? "), "m").when(prefix.rlike(rf"(?:^| )(?:{TITLES['f']})\.? "), "f")


def _read(x: Column) -> Column:
    """The parts of a finding. Later steps use these fields, so that no step holds another's expression many times over."""
    return F.struct(_prefix(x).alias("prefix"), _core(x).alias("core"), _kind(x).alias("kind"))


def _separated(kind: Column) -> Column:
    """Only these kinds ignore signs; their formats are short."""
    return kind.isin("card", "phone", "ssn", "iban")


def _entity(kind, canonical: Column, gender: Column) -> Column:
    return F.struct(F.concat(kind, F.lit("|"), canonical).alias("entity"), gender.alias("gender"))


def _entities(p: Column) -> Column:
    """The entities of a finding, each as its kind, a bar and its canonical form, and the gender of a first name's titles."""
    core, kind, none = p["core"], p["kind"], F.lit(None).cast("string")
    names = F.split(core, " ")
    canonical = (
        F.when(kind.isin("email", "ipv6"), F.lower(core)).when(_separated(kind), F.regexp_replace(core, "[^0-9A-Za-z]", "")).otherwise(core)
    )
    return F.when(
        kind == "name",
        F.concat(
            F.transform(
                F.slice(names, F.lit(1), F.size(names) - 1),
                lambda given: _entity(F.lit("given"), F.initcap(given), _gender(p["prefix"])),
            ),
            F.array(_entity(F.lit("surname"), F.initcap(F.element_at(names, -1)), none)),
        ),
    ).otherwise(F.array(_entity(kind, canonical, none)))


# -- surrogates ---------------------------------------------------------------


def _stream(key: str, *what: Column) -> Column:
    """96 keyed bytes in hex."""
    text = F.concat_ws("|", F.lit(key), *what)
    blocks = [F.sha2(F.concat(F.lit(key), F.sha2(F.concat(text, F.lit(f"|{i}")), 256)), 256) for i in range(3)]
    return F.concat(*blocks)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(96)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(values: str, n: Column) -> Column:
    words = values.split()
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))) + 1)


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


# The letters that stand in for others, by script.
LETTERS = {
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}


def _like(canonical: Column, stream: Column, domain_stream: Column, keep: Column, keep_to: Column) -> Column:
    """Each letter and digit by one of its sort; the characters before ``keep`` and from ``keep_to`` on stay.

    All but the characters are columns of the entity, so that nothing is worked out anew for every character.
    """
    at, hexadecimal = F.col("at"), F.col("hexadecimal")

    def one(c: Column, i: Column) -> Column:
        b = F.when((at > 0) & (i >= at), _byte(domain_stream, i - at)).otherwise(_byte(stream, i))
        letter = lambda letters: F.substring(F.lit(letters), (F.pmod(b, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        out = (
            F.when((i < keep) | (i >= keep_to), c)
            .when(hexadecimal & c.rlike("[0-9a-f]"), letter("0123456789abcdef"))
            .when(c.rlike("[0-9]"), letter("0123456789"))
            .when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        )
        for script, letters in LETTERS.items():
            out = out.when(c.rlike(rf"\p{{Lu}}") & c.rlike(script), F.upper(letter(letters))).when(c.rlike(script), letter(letters))
        return out.when(c.rlike(r"\p{N}"), letter("0123456789")).otherwise(c)

    return F.array_join(F.transform(_chars(canonical), one), "")


def _longer(made: Column, stream: Column, n: int) -> Column:
    """More letters in front, where those of the entity's own length don't suffice."""
    if n <= 0:
        return made
    alphabet = " ".join("abcdefghijklmnopqrstuvwxyz")
    return F.concat(*[_pick(alphabet, _byte(stream, F.lit(95 - i))) for i in range(n)], made)


def _luhn(digits: Column) -> Column:
    """The check digit for digits that lack it."""
    turned = _chars(F.reverse(digits))
    total = F.aggregate(
        F.transform(turned, lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int") - 9 * (c.cast("int") > 4).cast("int")).otherwise(c.cast("int"))),
        F.lit(0),
        lambda s, d: s + d,
    )
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _checked_card(original: Column, made: Column) -> Column:
    own = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    valid = _luhn(own(original)) == F.substring(original, -1, 1)
    return F.when(valid, F.concat(own(made), _luhn(own(made)))).otherwise(made)


def _checked_iban(made: Column) -> Column:
    """Country and account with the check digits that belong to them."""
    country, account = F.substring(made, 1, 2), F.substring(made, F.lit(5), F.length(made))
    turned = _chars(F.concat(account, country, F.lit("00")))
    rest = F.aggregate(
        turned,
        F.lit(0),
        lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _name(kind: Column, name: Column, stream: Column, attempt: int) -> Column:
    """A first name of the gender and script (with a second one out of syllables at later attempts), or a surname out of syllables."""
    out = None
    for script, syllables in SYLLABLES.items():
        spoken = lambda n: F.initcap(F.concat(*[_pick(syllables, _byte(stream, F.lit(i))) for i in range(1, n + 1)]))  # noqa: B023, E731
        chosen = F.when(kind == "surname", spoken(3 + attempt))
        for gender in TITLES:
            first = _pick(GIVEN[gender, script], _byte(stream, F.lit(0)))
            chosen = chosen.when(kind == f"given-{gender}", F.concat_ws("-", first, spoken(1 + attempt)) if attempt else first)
        case = _script(name) == script
        out = F.when(case, chosen) if out is None else out.when(case, chosen)
    return out


def _described(entities: DataFrame) -> DataFrame:
    """Distinct entities with all that their surrogates are made of, a column each; written, so that it is worked out once."""
    canonical = F.substring("entity", F.instr("entity", "|") + 1, F.length("entity"))
    parts = entities.select(
        "entity", "gender", F.substring_index("entity", "|", 1).alias("kind"), canonical.alias("canonical")
    )
    kind, own, n = F.col("kind"), F.col("canonical"), F.length("canonical")
    key = F.length(F.regexp_extract(own, r"^(?:AKIA|(?:ghp|gho|sk|pk)[_\-])", 0))
    keep = (
        F.when(kind == "card", 1).when(kind == "iban", 2).when(kind == "secret", key)
        .when((kind == "phone") & own.startswith("0"), 1).when((kind == "phone") & (n > 10), n - 10).otherwise(0)
    )
    hexadecimal = (kind == "ipv6") | (kind == "secret") & own.rlike("^[0-9a-f]+$")
    return stored(
        parts.withColumns(
            {
                "at": F.when(kind == "email", F.instr("canonical", "@")).otherwise(0),
                "keep": keep,
                "keep_to": F.when(kind == "email", n - F.length(F.substring_index("canonical", ".", -1))).otherwise(n),
                "hexadecimal": hexadecimal,
                # Addresses of one domain share the surrogate of the domain, at every attempt.
                "form": F.sha2(F.col("entity").cast("binary"), 256),
                "domain_form": F.sha2(F.substring_index("canonical", "@", -1).cast("binary"), 256),
            }
        ),
        "pii-entities",
    )


def _tried(pending: DataFrame, key: str, attempt: int) -> DataFrame:
    """``entity, surrogate``: the surrogates of an attempt. A few bytes make much work here, so rows are dealt to all tasks."""
    kind, canonical = F.col("kind"), F.col("canonical")
    tasks = int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams = pending.repartition(tasks, "entity").withColumns(
        {"stream": _stream(key, F.col("form"), F.lit(str(attempt))), "domain_stream": _stream(key, F.lit("domain"), F.col("domain_form"))}
    )
    made = surrogate(kind, canonical, F.col("gender"), F.col("stream"), F.col("domain_stream"), attempt)
    return streams.withColumn("surrogate", made).drop("stream", "domain_stream")


def surrogate(kind: Column, canonical: Column, gender: Column, stream: Column, domain_stream: Column, attempt: int) -> Column:
    """The surrogate of a described entity at an attempt, from its keyed bytes and those of its domain."""
    like = _like(canonical, stream, domain_stream, F.col("keep"), F.col("keep_to"))
    octets = [F.when(F.lit(i == 0), 1 + _byte(stream, F.lit(i)) % 223).otherwise(_byte(stream, F.lit(i))) for i in range(4)]
    person = F.when(kind == "given", F.concat(F.lit("given-"), gender)).otherwise(kind)
    return (
        F.when(kind.isin("given", "surname"), _name(person, canonical, stream, attempt))
        .when(kind == "ipv4", F.concat_ws(".", *[o.cast("string") for o in octets]))
        .when(kind == "card", _checked_card(canonical, like))
        .when(kind == "iban", _checked_iban(like))
        .when(kind.isin("email", "secret"), _longer(like, stream, attempt - 1))
        .otherwise(like)
    )


def assign(entities: DataFrame, key: str, attempts: int = 400) -> DataFrame:
    """``entity, surrogate`` for distinct ``entity``, no two of a kind alike and none an entity itself.

    ``entities`` also has ``gender``: m, f or n of a first name.
    """
    described = _described(entities)
    pending, settled = described, None
    taken = described.select(F.col("entity").alias("made"))
    names = described.columns
    for attempt in range(attempts):
        # Written, as it is read twice below: made once, and its large expressions are in one plan only.
        tried = stored(_tried(pending, key, attempt).withColumn("new", F.lit(True)), "tried")
        both = tried if settled is None else tried.unionByName(settled.withColumn("new", F.lit(False)))
        made = F.concat("kind", F.lit("|"), F.col("surrogate"))
        both = both.withColumn("made", made)
        first = both.groupBy("kind", "surrogate").agg(F.min(F.struct("new", "entity")).alias("first"))
        checked = (
            both.join(first, ["kind", "surrogate"])
            .join(taken.withColumn("own", F.lit(True)), "made", "left")
            .select(*names, "surrogate", ((F.col("first.entity") == F.col("entity")) & F.col("own").isNull()).alias("good"))
        )
        checked = stored(checked, "surrogates")
        settled = checked.filter("good").drop("good")
        pending = checked.filter("not good").drop("good", "surrogate")
        if pending.isEmpty():
            return settled.select("entity", "surrogate")
    raise RuntimeError(f"surrogates still collide after {attempts} attempts")


def _rendered(core: Column, kind: Column, made: Column) -> Column:
    """A finding's entity as its surrogate, in its own spelling."""
    first = made[0]

    def spelt(c: Column, new: Column) -> Column:
        return F.when(c.rlike(r"\p{Lu}"), F.upper(new)).when(c.rlike(r"[\p{L}\p{N}]"), new).otherwise(c)

    def separated(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(core, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
        return spelt(c, F.substring(first, at, F.lit(1)))

    def word(own: Column, new: Column) -> Column:
        return F.when(own.rlike(r"^[^\p{Ll}]{2,}$"), F.upper(new)).otherwise(new)

    return (
        F.when(kind == "name", F.array_join(F.zip_with(F.split(core, " "), made, word), " "))
        .when(_separated(kind), F.array_join(F.transform(_chars(core), separated), ""))
        .when((kind == "ipv4") | (F.length(first) != F.length(core)), first)
        .otherwise(F.array_join(F.zip_with(_chars(core), _chars(first), spelt), ""))
    )


def pseudonymise(docs: DataFrame, key: str = "set your own key") -> DataFrame:
    """``docs`` with all findings in ``text`` replaced, and ``n_entities``, the number of findings, last.

    Use a secret ``key``; the same key gives the same surrogates as long as the corpus has no new collisions.
    """
    names = docs.columns
    text = F.col(f"row.c{names.index('text')}").cast("string")
    # Texts are matched once; what was found is kept beside them.
    findings = F.when(_may_match(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    matched = wrapped(docs).withColumn("findings", findings)
    matched = matched.withColumn("has", F.coalesce(F.size("findings") > 0, F.lit(False)))
    staged = stored(
        matched.withColumn("digest", F.when(F.col("has"), F.unhex(F.sha2(text.cast("binary"), 256)))), "pii-texts"
    )
    found = staged.filter("has").withColumn("text", text)
    # A row per entity of every finding, once for texts that are equal.
    texts = found.groupBy("digest").agg(F.first("findings").alias("findings"))
    each = texts.select("digest", F.posexplode(F.transform("findings", _read)).alias("at", "p"))
    parts = stored(
        each.select("digest", "at", "p", F.posexplode(_entities(F.col("p"))).alias("part", "e")).select(
            "digest", "at", "part", "e.entity", "e.gender",
            # A finding may be as long as a text, so only its first part carries it.
            *[F.when(F.col("part") == 0, F.col(f"p.{c}")).alias(c) for c in ("prefix", "core", "kind")],
        ),
        "pii-parts",
    )
    genders = [F.coalesce(F.max(F.col("gender") == g), F.lit(False)) for g in "mf"]
    only = F.when(genders[0] & ~genders[1], "m").when(genders[1] & ~genders[0], "f").otherwise("n")
    chosen = assign(parts.groupBy("entity").agg(only.alias("gender")), key)
    offered = chosen.withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
    spread = parts.withColumn("salt", F.pmod(F.xxhash64("digest", "at"), F.lit(SALTS)).cast("int"))
    made = (
        spread.join(offered, ["entity", "salt"])
        .groupBy("digest", "at")
        .agg(
            *[F.max(c).alias(c) for c in ("prefix", "core", "kind")],
            F.array_sort(F.collect_list(F.struct("part", "surrogate")))["surrogate"].alias("made"),
        )
        .select("digest", "at", F.concat("prefix", _rendered(F.col("core"), F.col("kind"), F.col("made"))).alias("new"))
    )
    known = made.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("at", "new")))["new"].alias("replaced"))
    kept = F.split("text", PATTERN, -1)
    joined = found.join(known, "digest")
    new = F.array_join(F.transform(kept, lambda s, i: F.concat(s, F.coalesce(F.get("replaced", i), F.lit("")))), "")
    changed = joined.select("row", new.alias("text"), F.size("findings").alias("n_entities"))
    rest = staged.filter("not has").select("row", text.alias("text"), F.lit(0).alias("n_entities"))
    out = changed.union(rest)
    instead = {"text": F.col("text")}
    if "n_chars" in names:
        instead["n_chars"] = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col(f"row.c{names.index('n_chars')}")
        )
    return unwrapped_with(out, names, instead)


def unwrapped_with(out: DataFrame, names: list[str], instead: dict[str, Column]) -> DataFrame:
    named = [instead.get(n, F.col(f"row.c{i}")).alias(n) for i, n in enumerate(names)]
    return out.select(*named, F.col("n_entities").alias(_unused("n_entities", names)))


def _unused(name: str, names: list[str]) -> str:
    while name in names:
        name += "_"
    return name


def replace_all(docs: DataFrame, key: str = "set your own key") -> DataFrame:
    """``pseudonymise`` with the columns of ``docs`` only."""
    out = pseudonymise(docs, key)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
