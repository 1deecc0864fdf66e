"""Operator 1: surrogates for personal data, in DataFrame functions only.

Detected entities (e-mail, phone, card, IBAN, SSN, IPv4, IPv6, MAC, access
keys and passwords, names) are replaced by surrogates drawn from a keyed hash:

* the type and the layout stay: digits become digits, letters letters of the
  same script and case, separators stay; cards pass Luhn, IBANs mod 97, private
  addresses stay private, phones keep the country code and e-mails the
  top-level domain; given names keep the gender (by name list, else by title)
  and the script;
* coreference stays: an entity is mapped by its bare form (lower case, digits
  only), so all its spellings get one surrogate, in every document; an e-mail
  is mapped as mailbox and domain, a name word by word;
* distinctness stays: surrogates are checked against each other and, but for
  names, against the real entities of the corpus, and all but one of those that
  collide are drawn again, a fixed number of rounds;
* where a layout has no room (half of its values are real, as with thousands of
  addresses of one private network) its entities are permuted instead: each
  takes the next one's value in a keyed order, so all stay distinct, none keeps
  its own, and check digits hold.

Cards and IBANs with wrong check digits are numbers, not entities, and stay.
A value without letters and digits (a masked password) gets a drawn ending.

Defined cases: null text stays null; texts without an entity stay unchanged;
null ids are ordinary values; repeated rows are treated alike; an empty table
gives an empty result; other columns pass unchanged, and an input column
named ``n_entities`` is replaced.

Scale: only documents with an entity are shuffled.  Entities are distinct
before the collision rounds, each of which is one grouped count and one join
on the entity table; a name or address that a third of the documents hold is
one row there, and its occurrences meet it in a join of written tables, which
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stage

# ---- fixed values: titles, names and alphabets ----
TITLES_M = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "Госпожа")
TITLES_N = ("Dr", "Prof")
GIVEN = {
    ("m", "latin"): ("James", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel",
                     "Matthew", "Jürgen", "Wolfgang", "Stefan", "Pierre", "François", "Carlos", "Javier", "Miguel"),
    ("f", "latin"): ("Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Margaret", "Dorothy",
                     "Michelle", "Ursula", "Sabine", "Katrin", "Françoise", "Chantal", "Carmen", "Lucía", "Beatriz"),
    ("m", "cyrillic"): ("Александр", "Дмитрий", "Сергей", "Андрей", "Алексей", "Михаил", "Николай", "Владимир"),
    ("f", "cyrillic"): ("Екатерина", "Мария", "Наталья", "Ольга", "Татьяна", "Светлана", "Людмила", "Галина"),
}
SURNAMES = {
    "latin": ("Abbott", "Bradley", "Carver", "Dawson", "Ellison", "Fletcher", "Granger", "Hartmann", "Ingram", "Jansen",
              "Keller", "Lombard", "Mercier", "Navarro", "Osborne", "Pemberton", "Quintana", "Rousseau", "Schreiber",
              "Thornton", "Underwood", "Valdez", "Whitaker", "Zimmermann"),
    "cyrillic": ("Иванов", "Смирнов", "Кузнецов", "Попов", "Соколов", "Лебедев", "Козлов", "Новиков"),
}
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "han": "明华伟芳秀丽强军洋勇艳杰娟涛超兰",
    "kana": "あいうえおかきくけこさしすせそたちつてと",
    "hangul": "가나다라마바사아자차카타파하고노도로모보",
}
_SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "hebrew": r"\p{IsHebrew}", "arabic": r"\p{IsArabic}",
            "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}"}

# ---- patterns ----
_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ASSIGN = r"(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_TITLE = "(?:" + "|".join(TITLES_M + TITLES_F + TITLES_N) + r")\b\.?"
_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"
_GIVEN = "(?:" + "|".join(n for names in GIVEN.values() for n in names) + ")"
#: Every alternative opens with a look at the characters it can start with, so
#: that most positions of a text fail at once.
_NAMES = r"(?=[A-ZА-Я])" + _B + "(?:" + _TITLE + " " + _NAME + "(?: " + _NAME + "){0,2}|" + _GIVEN + " " + _NAME + _E + ")"
_MARKS = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,126}\p{L}{2,}+",
    r"(?=[pPsStTaA])" + _B + _ASSIGN + r"[^\s\"',;]{6,}+",
    r"(?=A)" + _B + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _E,
    r"(?=[A-Z]{2}\d)" + _B + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E,
    r"(?=[0-9A-Fa-f]{1,4}[:-])(?:(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])"
    r"|(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\p{L}\p{N}:])"
    r"|(?<![\p{L}\p{N}:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}:-]))",
    r"(?=[0-9])(?:(?<![\p{L}\p{N}.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\p{L}\p{N}]|\.\d)"
    r"|(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
    r"|(?<![\p{L}\p{N}+.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}]|-\d)"
    r"|(?<![\p{L}\p{N}+.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5})(?![\p{L}\p{N}]|-\d))",
    r"(?=\+\d)(?<![\p{L}\p{N}+.])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?![\p{L}\p{N}]|-\d)"
    r"|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}]|-\d))",
    r"(?=\(\d)(?<![\p{L}\p{N}+.-])\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\p{L}\p{N}]|-\d)",
])
#: Country codes of the numbering plan: one digit, two, else three.
_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ROUNDS, BUCKET = 12, 1024
PATTERN = _MARKS + "|" + _NAMES
NAME_TYPES = ("given_m", "given_f", "given_n", "surname", "surname_f")


def _type(e: Column) -> Column:
    rules = [
        ("email", r"^[^\s@]+@[^\s@]+$"), ("assign", "^" + _ASSIGN), ("key", r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"),
        ("iban", r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), ("ip", r"^\d{1,3}(?:\.\d{1,3}){3}$"),
        ("hex", r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$|^(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}$"),
        ("ssn", r"^\d{3}-\d{2}-\d{4}$"),
        ("card", r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})$"), ("phone", r"^[+(\d]")]
    out = F.lit("name")
    for name, rule in reversed(rules):
        out = F.when(e.rlike(rule), name).otherwise(out)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    back = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _mod97(c: Column) -> Column:
    """A string of digits and A-Z, letters read as 10..35, modulo 97."""
    return F.aggregate(F.split(c, ""), F.lit(0), lambda a, x: F.when(
        x.rlike("[0-9]"), (a * 10 + x.cast("int")) % 97).when(
        x.rlike("[A-Z]"), (a * 100 + F.ascii(x) - 55) % 97).otherwise(a))


def _parts(e: Column, kind: Column) -> Column:
    """The entity as an array of (type, raw); type 'lit' is copied."""
    def part(t, raw):
        return F.struct((t if isinstance(t, Column) else F.lit(t)).alias("type"), raw.alias("raw"))

    words = F.split(e, " ")
    titled = words[0].rlike("^" + _TITLE + "$")
    plain = F.regexp_replace(words[0], r"\.", "")
    title_gender = F.when(titled & plain.isin(*TITLES_M), "m").when(titled & plain.isin(*TITLES_F), "f").otherwise("n")

    def name_word(w, i):
        first = i == F.when(titled, 1).otherwise(0)
        alone = F.size(words) == F.when(titled, 2).otherwise(1)
        gender = (F.when(w.isin(*[n for k, v in GIVEN.items() if k[0] == "m" for n in v]), "m")
                  .when(w.isin(*[n for k, v in GIVEN.items() if k[0] == "f" for n in v]), "f").otherwise(title_gender))
        surname = F.when(w.rlike("^" + _SCRIPTS["cyrillic"]) & w.rlike("а$"), "surname_f").otherwise("surname")
        return F.when(titled & (i == 0), F.lit("lit")).when(first & ~alone, F.concat(F.lit("given_"), gender)).otherwise(surname)

    names = F.flatten(F.transform(words, lambda w, i: F.array(
        part("lit", F.when(i == 0, "").otherwise(" ")), part(name_word(w, i), w))))
    bare = F.regexp_replace(e, " ", "")
    lead = F.regexp_extract(e, "^(" + _ASSIGN + ")", 1)
    good_iban = _mod97(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))) == 1
    return (F.when(kind == "email", F.array(part("mailbox", F.substring_index(e, "@", 1)), part("lit", F.lit("@")),
                                            part("domain", F.substring_index(e, "@", -1))))
            .when(kind == "assign", F.array(part("lit", lead), part("secret", e.substr(F.length(lead) + 1, F.length(e)))))
            .when(kind == "key", F.array(part("lit", F.substring(e, 1, 4)), part("secret", F.substring(e, 5, 16))))
            .when(kind == "name", names)
            .when(kind == "card", F.array(part(F.when(_luhn_sum(_digits(e)) % 10 == 0, "card").otherwise("lit"), e)))
            .when(kind == "iban", F.array(part(F.when(good_iban, "iban").otherwise("lit"), e)))
            .otherwise(F.array(part(kind, e))))


def _norm(kind: Column, raw: Column) -> Column:
    """The bare form by which an entity is mapped."""
    digits = _digits(raw)
    return (F.when(kind.isin("card", "ssn"), digits)
            .when(kind == "phone", F.regexp_replace(F.when(raw.startswith("+"), F.regexp_replace(digits, _CODE, ""))
                                                    .otherwise(digits), "^0+(?=\\d)", ""))
            .when(kind == "iban", F.regexp_replace(raw, " ", ""))
            .when(kind.isin("secret", "ip"), raw)
            .otherwise(F.lower(raw)))


def _drawn(key: str) -> Column:
    """128 hex digits for (type, norm, attempt)."""
    seed = [F.lit(key), F.col("type"), F.col("norm"), F.col("attempt").cast("string")]
    return F.concat(*[F.sha2(F.concat_ws("\u0001", *seed, F.lit(str(i))), 256) for i in range(2)])


def _byte(i) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 64
    return F.conv(F.substr(F.col("h"), (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, i) -> Column:
    return F.substr(F.lit(alphabet), _byte(i) % len(alphabet) + 1, F.lit(1))


def _like(text: Column, hexadecimal: bool = False) -> Column:
    """Every digit and letter of ``text`` replaced by a drawn one of its script and case."""
    def char(c, i):
        out = F.when(c.rlike(r"[0-9]"), (_byte(i) % 10).cast("string"))
        if hexadecimal:
            return F.when(c.rlike(r"[0-9A-Fa-f]"), F.substr(F.lit("0123456789abcdef"), _byte(i) % 16 + 1, F.lit(1))).otherwise(c)
        for script, rule in _SCRIPTS.items():
            out = out.when(c.rlike(rule), _pick(ALPHABETS[script], i))
        return (out.when(c.rlike(r"\p{Lu}"), F.upper(_pick(ALPHABETS["latin"], i)))
                .when(c.rlike(r"\p{L}"), _pick(ALPHABETS["latin"], i)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), char), "")


def _surrogate() -> Column:
    """Surrogate of (type, norm, attempt, h), in bare form."""
    kind, norm, attempt = F.col("type"), F.col("norm"), F.col("attempt")
    longer = F.substr(F.translate(F.substr(F.col("h"), F.lit(65), F.lit(64)), "0123456789", "ghijklmnop"), F.lit(1),
                      F.expr("attempt div 4").cast("int"))
    digits = F.array_join(F.transform(F.split(norm, ""), lambda c, i: (_byte(i) % 10).cast("string")), "")
    n = F.length(norm)
    body = F.concat(F.left(norm, F.lit(1)), F.substr(digits, F.lit(2), n - 2))
    card = F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    bban = _like(F.substr(norm, F.lit(5), F.lit(40)))
    iban = F.concat(F.left(norm, F.lit(2)), F.lpad((98 - _mod97(F.concat(bban, F.left(norm, F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), bban)
    octet = [(_byte(i) % 256).cast("string") for i in range(4)]
    ip = (F.when(norm.rlike(r"^(?:10|127)\."), F.concat_ws(".", F.substring_index(norm, ".", 1), *octet[1:]))
          .when(norm.rlike(r"^192\.168\."), F.concat_ws(".", F.lit("192.168"), *octet[2:]))
          .when(norm.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), (16 + _byte(1) % 16).cast("string"), *octet[2:]))
          .otherwise(F.concat_ws(".", (11 + _byte(0) % 100).cast("string"), *octet[1:])))
    # Area codes and, in ten digits, exchanges begin with 2 to 9.
    lead = (2 + _byte(0) % 8).cast("string")
    phone = F.when(n == 10, F.concat(lead, F.substr(digits, F.lit(2), F.lit(2)), (2 + _byte(3) % 8).cast("string"),
                                     F.substr(digits, F.lit(5), F.lit(6)))).otherwise(
        F.concat(lead, F.substr(digits, F.lit(2), n)))
    head = F.regexp_extract(norm, r"^(.*)\.", 1)
    domain = F.concat(_like(head), longer, F.lit("."), F.substring_index(norm, ".", -1))

    def named(lists):
        # Names beyond the list, when all of it is taken, get a drawn ending.
        pool = F.array(*[F.lit(x) for x in lists])
        return F.concat(F.element_at(pool, (_byte(0) * 256 + _byte(1)) % len(lists) + 1), longer)

    cyr = norm.rlike("^" + _SCRIPTS["cyrillic"])
    lat = norm.rlike(r"^\p{IsLatin}")
    other = F.concat(_like(norm), longer)
    out = (F.when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", ip).when(kind == "phone", phone)
           .when(kind == "ssn", F.concat(F.lit("9"), F.substr(digits, F.lit(2), F.lit(8))))
           .when((kind == "hex") | (kind == "secret") & norm.rlike("^[0-9a-f]{16,}$"), _like(norm, hexadecimal=True)).when(kind == "domain", domain))
    for g in "mf":
        out = (out.when((kind == f"given_{g}") & lat, named(GIVEN[g, "latin"]))
               .when((kind == f"given_{g}") & cyr, named(GIVEN[g, "cyrillic"])))
    both = GIVEN["m", "latin"] + GIVEN["f", "latin"]
    return (out.when((kind == "given_n") & lat, named(both)).when((kind == "surname") & lat, named(SURNAMES["latin"]))
            .when((kind == "surname") & cyr, named(SURNAMES["cyrillic"]))
            .when((kind == "surname_f") & cyr, named([x + "а" for x in SURNAMES["cyrillic"]])).otherwise(other))


def _layout(kind: Column, norm: Column) -> Column:
    """What a value shares with those it may be exchanged for: kinds of characters, and the network of an address."""
    shape = norm
    for i, rule in enumerate(_SCRIPTS.values()):
        shape = F.regexp_replace(shape, rule, chr(0xE000 + i))
    for rule, mark in ((r"\p{Lu}", "A"), (r"\p{L}", "a"), (r"\p{Nd}", "0")):
        shape = F.regexp_replace(shape, rule, mark)
    network = F.regexp_extract(norm, r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", 0)
    return (F.when(kind == "ip", F.when(network.startswith("172."), "172.").otherwise(network))
            .when(kind == "hex", F.regexp_replace(norm, "[0-9a-f]", "x"))
            .when(kind == "iban", F.concat(F.left(norm, F.lit(2)), shape)).otherwise(shape))


def _exchanged(entities: DataFrame, key: str) -> DataFrame:
    """(type, norm, surrogate): each entity takes the value of the next one of its layout, in a keyed order.

    A large layout is exchanged in buckets of about ``BUCKET``."""
    sizes = entities.groupBy("type", "layout").agg(F.greatest(F.lit(1), F.expr(f"count(*) div {BUCKET}")).alias("buckets"))
    order = F.xxhash64(F.lit(key), "norm")
    placed = entities.join(sizes, ["type", "layout"]).withColumn("bucket", F.pmod(F.xxhash64("norm", F.lit(key)), "buckets"))
    ring = Window.partitionBy("type", "layout", "bucket").orderBy(order, "norm")
    first = F.first("norm").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return placed.select("type", "norm", F.coalesce(F.lead("norm").over(ring), first).alias("surrogate"))


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """(type, norm, surrogate) for distinct (type, norm), without collisions inside a type."""
    now = stage(entities.withColumn("attempt", F.lit(0)), "pii-entities")
    for _ in range(ROUNDS):
        drawn = stage(now.withColumn("h", _drawn(key)).withColumn("surrogate", _surrogate())
                      .select("type", "norm", "attempt", "surrogate"), "pii-drawn")
        # The first by hash of those that share a surrogate keeps it.
        rank = F.xxhash64("norm")
        shared = (drawn.groupBy("type", F.lower("surrogate").alias("s"))
                  .agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1"))
        real = drawn.select("type", F.lower("norm").alias("s"), F.lit(True).alias("real"))
        again = stage(drawn.withColumn("s", F.lower("surrogate")).join(shared, ["type", "s"], "left")
                      .join(real.distinct(), ["type", "s"], "left")
                      .withColumn("again", (F.col("n").isNotNull() & (rank != F.col("first")))
                                  | (F.col("s") == F.lower("norm"))
                                  | (F.col("real").isNotNull() & ~F.col("type").isin(*NAME_TYPES)))
                      .select("type", "norm", "attempt", "surrogate", "again"), "pii-checked")
        if not again.where("again").limit(1).count():
            return again.select("type", "norm", "surrogate")
        now = again.select("type", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    # No room: whole layouts, those resolved included, so that no two meet.
    laid = stage(again.withColumn("layout", _layout(F.col("type"), F.col("norm"))), "pii-laid")
    full = laid.where("again").select("type", "layout").distinct()
    rest = laid.join(full, ["type", "layout"], "left_anti").select("type", "norm", "surrogate")
    return rest.unionByName(_exchanged(laid.join(full, ["type", "layout"], "left_semi"), key))


def _shaped(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The bare surrogate in the layout of the occurrence."""
    chars = F.split(raw, "")
    total = F.length(F.regexp_replace(raw, r"\D", ""))

    def digit(c, i):
        nth = F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), r"\D", ""))
        # Counted from the right: a country code before the mapped digits stays.
        at = nth - (total - F.length(surrogate))
        return F.when(c.rlike(r"\d") & (at > 0), F.substr(surrogate, at, F.lit(1))).otherwise(c)

    def sign(c, i):
        nth = F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), " ", ""))
        return F.when(c == " ", c).otherwise(F.substr(surrogate, nth, F.lit(1)))

    # Letters take the case of the character in their place; what a longer
    # surrogate has beyond the occurrence stays as drawn.
    cased_text = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(
        F.coalesce(F.get(chars, i), F.lit("")).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return (F.when(kind == "lit", raw)
            .when(kind.isin("card", "ssn", "phone"), F.array_join(F.transform(chars, digit), ""))
            .when(kind == "iban", F.array_join(F.transform(chars, sign), ""))
            .when(kind == "hex", F.when(raw.rlike("[A-F]"), F.upper(surrogate)).otherwise(surrogate))
            .when(kind.isin("mailbox", "domain"), cased_text)
            .when(kind.isin(*NAME_TYPES) & (F.length(raw) > 1) & (F.upper(raw) == raw), F.upper(surrogate))
            .when(kind.isin(*NAME_TYPES), F.initcap(surrogate))
            .otherwise(surrogate))


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with surrogates in ``text`` and ``n_entities`` (replaced entities, long)."""
    docs = docs.drop("n_entities")
    own = "__"  # of helper columns: no column of the input begins with it
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    key_col, found_col, out_col, n_col = (own + x for x in ("key", "found", "out", "n"))
    # All but names hold a digit, an at sign or an assignment; a text without
    # one needs only the search for names.
    has = F.coalesce((F.col(text).rlike("[0-9@=:]") & F.col(text).rlike(_MARKS)) | F.col(text).rlike(_NAMES), F.lit(False))
    some = stage(docs.where(has).select(
        "*", F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)).alias(found_col),
        F.struct(row_key(F.col(doc_id), F.col(text)).alias("a"), row_key(F.col(text), F.col(doc_id), seed=1).alias("b")).alias(key_col)),
        "pii-documents")
    e = F.col("e")
    found = (some.select(key_col, found_col).dropDuplicates([key_col])
             .select(key_col, F.posexplode(found_col).alias("i", "e"))
             .select(key_col, "i", F.posexplode(_parts(e, _type(e))).alias("j", "p"))
             .select(key_col, "i", "j", "p.type", "p.raw", _norm(F.col("p.type"), F.col("p.raw")).alias("norm")))
    found = stage(found, "pii-occurrences")
    mapping = stage(surrogate_map(found.where("type != 'lit'").select("type", "norm").distinct(), key), "pii-map")
    shaped = (found.join(mapping, ["type", "norm"], "left")
              .withColumn("out", _shaped(F.col("type"), F.col("raw"), F.col("surrogate"))))
    whole = (shaped.groupBy(key_col, "i").agg(
        F.array_join(F.expr("transform(array_sort(collect_list(struct(j, out))), x -> x.out)"), "").alias("out"),
        F.max((F.col("type") != "lit").cast("long")).alias("real"))
        .groupBy(key_col).agg(F.expr("transform(array_sort(collect_list(struct(i, out))), x -> x.out)").alias(out_col),
                              F.sum("real").alias(n_col)))
    new = F.array_join(F.transform(F.split(F.col(text), PATTERN, -1),
                                   lambda p, i: F.concat(p, F.coalesce(F.get(F.col(out_col), i), F.lit("")))), "")
    replaced = some.join(stage(whole, "pii-replacements"), key_col).select(
        *[new.alias(text) if c == text else F.col(c) for c in docs.columns], F.col(n_col).alias("n_entities"))
    return docs.where(~has).withColumn("n_entities", F.lit(0).cast("long")).unionByName(replaced)
