"""Personal data replaced by surrogates, in DataFrame functions only.

Entities are found by patterns, once. Each distinct entity (of one type, in its normal form) gets a surrogate from a
keyed digest (HMAC): digits stand for digits and letters for letters of the same script and case, none for itself. Names
are taken word by word, so that "Mr. John Smith", "Dr. John Smith" and "Mr. Smith" share what they have in common: given
names are drawn by script and gender, family names by script. A name that a text gives with a title or in full goes wherever
the text has it again, as one word ("Smith said"), too. The surrogates are then checked against each other and
against the entities themselves; those that collide draw again, so that different entities stay different and one
entity has one surrogate everywhere.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.llm.common import join_hot, materialise, scratch_path, without

KEY_SETTING = "tracemark.pii.key"
LAST = 12  # from this draw on a surrogate is a tag with a digest, which nothing else can be
# fixed values: titles before names, by gender
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Doña", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
# fixed values: given names by script and gender; they are found without a title, and the first to be drawn
FIRST = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "James", "John", "Jonas", "Juan", "Marco", "Michael", "Nils", "Oscar", "Paul", "Peter", "Pierre", "Rene", "Robert", "Simon", "Thomas", "William",
                     "Andrew", "Anthony", "Benjamin", "Brandon", "Brian", "Daniel", "Donald", "Edward", "Eric", "Gary", "George", "Gregory", "Jeffrey", "Jonathan", "Joseph", "Joshua", "Kenneth", "Kevin", "Larry", "Matthew", "Nicholas", "Patrick", "Richard", "Ronald", "Ryan", "Stephen", "Steven", "Timothy"),
    ("latin", "f"): ("Alma", "Anna", "Bella", "Clara", "Diana", "Elena", "Elizabeth", "Flora", "Hanna", "Irene", "Jane", "Jennifer", "Julia", "Laura", "Maria", "Marie", "Mary", "Nora", "Olga", "Paula", "Rosa", "Sarah", "Sofia", "Susan",
                     "Amanda", "Amy", "Angela", "Ashley", "Barbara", "Betty", "Carol", "Cynthia", "Deborah", "Donna", "Emily", "Jessica", "Karen", "Kathleen", "Kimberly", "Linda", "Lisa", "Margaret", "Melissa", "Michelle", "Nancy", "Patricia", "Rebecca", "Sandra", "Sharon", "Stephanie"),
    ("latin", "n"): ("Alex", "Andrea", "Charlie", "Dominique", "Jackie", "Kim", "Mika", "Noel", "Robin", "Sam", "Sascha", "Toni", "Yael"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Тоша", "Юля"),
    ("greek", "m"): ("Αλέξης", "Γιάννης", "Δήμος", "Ηλίας", "Θωμάς", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Δανάη", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία", "Χαρά"),
    ("greek", "n"): ("Αλέξ", "Γκάμπι", "Νίκη", "Κρις", "Τζο", "Ρένια", "Φωτεινός", "Άρης"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "go", "ha", "he", "ka", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "po", "ra", "re", "ro", "sa", "se", "so", "ta", "to"),
    "cyrillic": ("ба", "бе", "во", "га", "да", "до", "за", "ка", "ко", "ла", "ли", "ма", "мо", "на", "но", "ра"),
    "greek": ("βα", "γα", "δε", "ζω", "θα", "κα", "κο", "λα", "λι", "μα", "μο", "να", "νο", "πα", "ρα", "τα"),
}
# endings of given names made of syllables
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "ria", ("latin", "n"): "li", ("cyrillic", "m"): "слав", ("cyrillic", "f"): "рия", ("cyrillic", "n"): "ля",
           ("greek", "m"): "νος", ("greek", "f"): "ρία", ("greek", "n"): "λι"}


def _letters(first: int, last: int, step: int = 1) -> str:
    return "".join(c for c in map(chr, range(first, last + 1, step)) if c.isalpha())


# what a character may be replaced by: of the same kind, script and case; the first class that takes it holds
ALPHABETS = (
    ("[0-9]", "0123456789"), ("[a-z]", _letters(0x61, 0x7A)), ("[A-Z]", _letters(0x41, 0x5A)),
    (r"[\p{IsLatin}&&\p{Ll}]", _letters(0xDF, 0xFF)), (r"[\p{IsLatin}&&\p{Lu}]", _letters(0xC0, 0xDE)),
    (r"[\p{IsCyrillic}&&\p{Lu}]", _letters(0x410, 0x42F)), (r"\p{IsCyrillic}", _letters(0x430, 0x44F)),
    (r"[\p{IsGreek}&&\p{Lu}]", _letters(0x391, 0x3A9)), (r"\p{IsGreek}", _letters(0x3B1, 0x3C1) + _letters(0x3C3, 0x3C9)),
    (r"\p{IsHebrew}", _letters(0x5D0, 0x5EA)), (r"\p{IsArabic}", _letters(0x628, 0x63A) + _letters(0x641, 0x64A)),
    (r"\p{IsDevanagari}", _letters(0x915, 0x939)), (r"\p{IsThai}", _letters(0xE01, 0xE2E)), (r"\p{IsHiragana}", _letters(0x3042, 0x3093)),
    (r"\p{IsKatakana}", _letters(0x30A2, 0x30F3)), (r"\p{IsHangul}", _letters(0xAC00, 0xD788, 28)), (r"\p{IsHan}", _letters(0x4E00, 0x4FFF)),
    (r"\p{N}", "0123456789"), (r"\p{L}", _letters(0x61, 0x7A)),
)
# scripts of initials, which are only rotated
INITIALS = (_letters(0x41, 0x5A), _letters(0x410, 0x42F), _letters(0x391, 0x3A9))
TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))
SHOUTED = "|".join(t.upper() for t in (*MALE, *FEMALE, *NEUTRAL))
SHORT = "mrs?|ms|mme|dr|prof"  # titles that a full stop tells from other words, in any case
GIVEN = "|".join(sorted({n for names in FIRST.values() for n in names}))
# names that stand for a person alone too; those of both genders are often other words
ALONE = "|".join(sorted({n for (_, g), names in FIRST.items() if g != "n" for n in names}))
# a hyphen or apostrophe joins what it stands between, but a possessive 's is no part of a name
JOINED = r"(?:(?!['\u2019][sS](?![\p{L}\p{M}]))['\u2019-][\p{L}\p{M}]++)*+"
WORD = rf"\p{{Lu}}(?:[\p{{L}}\p{{M}}]++|(?=['\u2019-]\p{{L}})){JOINED}"
SMALL_WORD = rf"\p{{Ll}}[\p{{L}}\p{{M}}]++{JOINED}"
# fixed values: the patterns of the types; quantifiers are possessive or bounded by what may stand beside them
EMAIL = r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+(?![\p{L}\p{N}])"
SECRET = (r"(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)(?![\p{L}\p{N}_]))\s*+[=:]\s*+"
          r"(?:\"[^\"\s]{6,}+\"|'[^'\s]{6,}+'|(?=[^\s\"',;]*\p{N})(?=[^\s\"',;]*\p{L})[^\s\"',;]{6,}+|[^\s\"',;]{12,}+)")
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})"
IP = rf"(?<!\.){OCTET}(?:\.{OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?!-?[\p{L}\p{N}])"
PHONE = r"(?<!\+)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])"
CARD = r"\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"
# an IPv6 address in full, or with one gap; a clock's time has too few parts
IPV6 = r"(?<![:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![:.]?[\p{L}\p{N}:])"
NATIONAL = r"(?<![\d.,/-])(?<!\d )(?:0\d{2,4}[ /-]\d{5,8}|\d{3} \d{3} \d{4})(?![ .,/-]?\p{N})(?!\p{L})"
NO_NAME = "AND|OR|OF|THE|IS|WAS|UND|ET|Y|" + SHOUTED
PERSON = (rf"(?:(?:{TITLES})\.? {WORD}(?: \p{{Lu}}\.(?= \p{{Lu}})| {WORD})*+|(?:{SHOUTED})\.?(?: (?!(?:{NO_NAME})(?![\p{{L}}\p{{N}}])){WORD}){{1,2}}+"
          rf"|(?i:{SHORT})\. (?!(?i:{SHORT})(?![\p{{L}}\p{{N}}]))(?:{SMALL_WORD}|{WORD})|(?:{GIVEN})(?: \p{{Lu}}\.(?= \p{{Lu}}))?(?: {WORD})++|(?:{ALONE})(?![\p{{L}}\p{{M}}\p{{N}}]))")
KINDS = (("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ip", IP), ("ipv6", IPV6), ("ssn", SSN), ("phone", f"(?:{PHONE}|{NATIONAL})"), ("card", CARD), ("person", PERSON))
# no entity begins inside a word: one look back spares nearly all places the patterns
ANY = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(p for _, p in KINDS)})"


class Digests:
    """HMAC-SHA256 of columns. The two padded keys are made on the driver and stand in the plan as they are."""

    def __init__(self, key: str):
        raw = key.encode()
        raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
        raw = raw.ljust(64, b"\0")
        self.key, self.inner, self.outer = key.encode(), bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)

    def of(self, *parts) -> Column:
        message = F.concat_ws("\x1f", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
        return F.sha2(F.concat(F.lit(self.outer), F.unhex(F.sha2(F.concat(F.lit(self.inner), F.encode(message, "UTF-8")), 256))), 256)

    def number(self, *parts: str) -> int:
        return int(hmac.new(self.key, "\x1f".join(parts).encode(), hashlib.sha256).hexdigest(), 16)


def key_of(spark: SparkSession, key: str | None) -> str:
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"give a key, as a parameter or in the setting {KEY_SETTING}")
    return key


def find(text: Column) -> Column:
    """All entities of a text in order."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(ANY), 0)


def kind_of(entity: Column) -> Column:
    """The first type whose pattern takes the whole entity, as the joint pattern found it."""
    out = F
    for kind, pattern in KINDS:
        out = out.when(entity.rlike(rf"^(?:{pattern})$"), kind)
    return out.otherwise("card")


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^(?iu:{TITLES})\.? ", 0)


def title_gender(entity: Column) -> Column:
    title = F.lower(F.regexp_replace(_title(entity), r"[. ]", ""))
    return F.when(title.isin(*map(str.lower, MALE)), "m").when(title.isin(*map(str.lower, FEMALE)), "f")


def _value(secret: Column) -> Column:
    return F.regexp_extract(secret, r"^[^=:]*[=:]\s*[\"']?(.*?)[\"']?$", 1)


def _script(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek")
            .when(word.rlike(r"\p{IsLatin}"), "latin").otherwise("other"))


def normal_form(kind: Column, entity: Column) -> Column:
    """What mentions of one entity have in common: lower-case addresses, bare digits, a secret's value. Phone numbers
    are international; those without a code have the form of the +1 region."""
    digits = F.regexp_replace(entity, r"\D", "")
    plain = F.regexp_replace(F.lower(entity), "(?<![0-9a-f])0+(?=[0-9a-f])", "")
    return (F.when(kind == "email", F.lower(entity)).when(kind == "secret", _value(entity)).when(kind == "ip", entity).when(kind == "ipv6", plain)
            .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
            .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise("+1"), digits)).otherwise(digits))


def parts_of(kind: Column, entity: Column) -> Column:
    """The (kind, norm) of which an entity's surrogate is made: of a person one for each word, the last a family name, but where
    it is all there is, without a title."""
    words = F.split(F.replace(entity, _title(entity), F.lit("")), " ")
    alone = (F.size(words) == 1) & (_title(entity) == "")

    def word(w, i):
        low = F.lower(w)
        of = F.when(w.endswith("."), "initial").when((i == F.size(words) - 1) & ~alone, "family").otherwise("given")
        return F.struct(of.alias("kind"), F.concat_ws("|", _script(low), low).alias("norm"))
    return F.when(kind == "person", F.transform(words, word)).otherwise(F.array(F.struct(kind.alias("kind"), normal_form(kind, entity).alias("norm"))))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _draw(digest: Column, i: Column, size) -> Column:
    """A number below size from the i-th place of a digest of 64 hex digits."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.pmod(F.conv(F.substr(digest, F.pmod(i, F.lit(60)) + 1, F.lit(5)), 16, 10).cast("long") + i, size).cast("int")


def _pick(digest: Column, i: int, choices) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), F.pmod(F.conv(F.substring(digest, i, 8), 16, 10).cast("long"), F.lit(len(choices))).cast("int") + 1)


def like(text: Column, digest: Column, first: Column, hexes: Column) -> Column:
    """Other characters of the same kinds, scripts and cases, each unlike the one it stands for; the first ones stay, and
    so do marks. hexes: letters stay hex digits. A text of nothing but marks becomes hex digits."""
    def alphabet(c, i):
        out = F.when(i < first, F.lit(None).cast("string")).when(hexes & c.rlike("[a-f]"), "abcdef").when(hexes & c.rlike("[A-F]"), "ABCDEF")
        for kind, letters in ALPHABETS:
            out = out.when(c.rlike(kind), letters)
        return F.struct(c.alias("c"), out.alias("of"))

    def swap(x, i):
        size, at = F.length(x["of"]), F.instr(x["of"], x["c"])  # at is 0 where the alphabet is for want of a better one
        step = F.when(at > 0, at + _draw(digest, i, size - 1)).otherwise(_draw(digest, i, size))
        return F.when(x["of"].isNull(), x["c"]).otherwise(F.substr(x["of"], F.pmod(step, size) + 1, F.lit(1)))
    swapped = F.array_join(F.transform(F.transform(_chars(text), alphabet), swap), "")
    return F.when(text.rlike(r"[\p{L}\p{N}]"), swapped).otherwise(F.substr(F.repeat(digest, F.length(text)), F.lit(1), F.length(text)))


def _luhn_sum(digits: Column, skip_last: bool = False) -> Column:
    """The Luhn sum of a digit string; skip_last leaves out the check digit."""
    order = F.reverse(F.transform(_chars(digits), lambda c: c.cast("int")))

    def worth(d, i):
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d if not skip_last else F.when(i == 0, 0).otherwise(d))
    return F.aggregate(F.transform(order, worth), F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """An IBAN's remainder: its first four characters last, letters as 10 to 35; 1 of a valid one."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _code_length(phone: Column) -> Column:
    """Digits of the country code of +digits, by the numbering plan's zones."""
    return (F.when(phone.rlike(r"^\+[17]"), 1)
            .when(phone.rlike(r"^\+(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 2).otherwise(3))


def drawn(entities: DataFrame, attempt: int, digests: Digests) -> DataFrame:
    """entities (kind, norm, gender) with sur, the surrogate of a normal form, itself a normal form of the type."""
    kind, norm, gender, digest, swapped, body = map(F.col, ("kind", "norm", "gender", "digest", "swapped", "body"))
    rows = entities.withColumns({"digest": digests.of(kind, norm, F.lit(attempt)), "at": F.instr(norm, "@"), "ending": F.regexp_extract(norm, r"\.[^.]+$", 0),
                                 "code": _code_length(norm), "valid": F.when(kind == "card", F.pmod(_luhn_sum(norm), F.lit(10)) == 0).when(kind == "iban", _mod97(norm) == 1)})
    name = kind.isin("family", "given")
    rows = rows.withColumns({
        "middle": F.when(kind == "email", F.substr(norm, F.col("at") + 1, F.length(norm) - F.col("at") - F.length("ending"))),
        "script": F.when(name, F.split(norm, r"\|", 2)[0]),
        "subject": F.when(kind == "email", F.substr(norm, F.lit(1), F.col("at") - 1)).when(kind == "phone", F.substr(norm, F.col("code") + 2))
        .when(name, F.split(norm, r"\|", 2)[1]).otherwise(norm)})
    rows = rows.withColumns({
        "swapped": like(F.col("subject"), digest, F.when(kind == "iban", F.when(F.col("valid"), 4).otherwise(2)).when((kind == "phone") & F.col("subject").startswith("0"), 1).otherwise(0),
                        (kind == "ipv6") | ((kind == "secret") & norm.rlike("^[0-9a-fA-F]+$"))),
        # one domain has one surrogate, whoever writes from it
        "domain": F.when(kind == "email", like(F.col("middle"), digests.of("domain", F.col("middle")), F.lit(0), F.lit(False)))})
    rows = rows.withColumn("body", F.when(kind == "iban", F.concat(F.substring(norm, 1, 2), F.lit("00"), F.substr(swapped, F.lit(5)))))

    email = F.concat(swapped, F.concat(F.lit("x"), F.substring(digest, 1, 8)) if attempt > 3 else F.lit(""), F.lit("@"), F.col("domain"), F.col("ending"))
    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: (F.pmod(
        F.conv(F.substr(digest, i * 8 + 1, F.lit(6)), 16, 10).cast("int"), F.lit(254)) + 1).cast("string")), ".")
    checked = F.concat(F.substr(swapped, F.lit(1), F.length(swapped) - 1), F.pmod(10 - F.pmod(_luhn_sum(swapped, True), F.lit(10)), F.lit(10)).cast("string"))
    iban = F.when(F.col("valid"), F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(body)).cast("string"), 2, "0"), F.substr(body, F.lit(5)))).otherwise(swapped)
    phone = F.concat(F.substr(norm, F.lit(1), F.col("code") + 1), swapped)

    def made(syllables, least: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(least + min(attempt, 7))), lambda i: F.element_at(
            F.array(*map(F.lit, syllables)), _draw(digest, i * 5, len(syllables)) + 1)), "")
    word = F
    for script, syllables in SYLLABLES.items():
        mine = F.col("script") == script
        word = word.when(mine & (kind == "family"), made(syllables, 3))
        for g in "mfn":
            own = F.lower(_pick(digest, 50, FIRST[script, g])) if not attempt else F.concat(made(syllables, 1), F.lit(ENDINGS[script, g]))
            word = word.when(mine & (F.coalesce(gender, F.lit("n")) == g), own)
    out = (F.when(kind == "email", email).when(kind == "iban", iban).when(kind == "ip", octets).when(kind == "phone", phone)
           .when((kind == "card") & F.col("valid"), checked).when(name, F.concat_ws("|", F.col("script"), word.otherwise(swapped))).otherwise(swapped))
    if attempt >= LAST:
        out = F.concat(F.lit("["), kind, F.lit(" "), F.substring(digest, 1, 24), F.lit("]"))
    return rows.select("kind", "norm", "gender", out.alias("sur"))


def render(kind: Column, entity: Column, surs: Column, digests: Digests) -> Column:
    """The surrogates of an entity's parts in the form of one mention: its marks, spaces, capitals, quotes and title."""
    sur = surs[0]
    n_digits = F.length(F.regexp_replace(entity, r"\D", ""))
    bare = F.regexp_replace(sur, r"\D", "")

    def fill(c, i):  # a number's last digits, as many as the mention has
        at = F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), r"\D", "")) + F.length(bare) - n_digits
        return F.when(c.rlike(r"\d"), F.substr(bare, at, F.lit(1))).otherwise(c)
    digits = F.array_join(F.transform(_chars(entity), fill), "")
    cased = F.array_join(F.transform(_chars(sur), lambda c, i: F.when(F.substr(entity, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    spaced = F.array_join(F.transform(_chars(entity), lambda c, i: F.when(c == " ", c).otherwise(
        F.substr(sur, F.length(F.replace(F.substr(entity, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    title = _title(entity)
    words = F.split(F.replace(entity, title, F.lit("")), " ")
    turns = [a[(k := 1 + digests.number("initials") % (len(a) - 1)):] + a[:k] for a in INITIALS]

    def word(w, i):
        return F.when(w.endswith("."), F.translate(w, "".join(INITIALS), "".join(turns))).otherwise(name_like(w, F.get(surs, i)))
    person = F.concat(title, F.array_join(F.transform(words, word), " "))
    return (F.when(kind == "person", person).when(kind == "secret", F.replace(entity, _value(entity), sur)).when(sur.startswith("["), sur)
            .when(kind == "email", cased).when(kind == "iban", spaced).when(kind.isin("ip", "ipv6"), sur).otherwise(digits))


def name_like(word: Column, sur: Column) -> Column:
    """A name's surrogate in the capitals of a word."""
    new = F.regexp_replace(sur, r"^[^|\[]*\|", "")
    return (F.when(new.startswith("["), new).when((F.upper(word) == word) & (F.length(word) > 1), F.upper(new))
            .when(F.lower(word) == word, F.lower(new)).otherwise(F.initcap(new)))


def mentioned_again(some: DataFrame, shown: DataFrame, text_col: str) -> DataFrame:
    """(_row, _again, n_again) of texts with names: what lies between the entities, with the names that the text's persons have
    (parts: _row, kind, norm, sur) replaced where they stand alone as capitalised words.

    Words meet names in a join by text and word, so that a long text with many names is the work of many tasks.
    """
    names = shown.filter(F.col("kind").isin("given", "family") & F.col("sur").isNotNull()).select("_row", F.split("norm", r"\|", 2)[1].alias("low"), "kind", "sur")
    names = names.filter(F.length("low") > 1).groupBy("_row", "low").agg(F.min_by("sur", F.struct(F.col("kind") != "family", "sur")).alias("sur"))
    capital = rf"(?<![\p{{L}}\p{{N}}]){WORD}"
    pieces = some.join(names.select("_row").distinct(), "_row", "left_semi").select("_row", F.posexplode(F.split(F.col(text_col), ANY, -1)).alias("i", "piece"))
    words = pieces.select("_row", "i", F.posexplode(F.regexp_extract_all("piece", F.lit(capital), 0)).alias("k", "w")).withColumn("low", F.lower("w"))
    met = words.join(names, ["_row", "low"], "left")
    new = F.struct("k", F.when(F.col("sur").isNull(), F.col("w")).otherwise(name_like(F.col("w"), F.col("sur"))).alias("new"))
    by_piece = met.groupBy("_row", "i").agg(F.sort_array(F.collect_list(new)).alias("news"), F.count("sur").alias("n"))
    joined = pieces.join(by_piece, ["_row", "i"], "left")
    between = F.split("piece", capital, -1)
    changed = F.array_join(F.transform(between, lambda p, k: F.concat(p, F.coalesce(F.get(F.col("news.new"), k), F.lit("")))), "")
    whole = F.when(F.coalesce("n", F.lit(0)) > 0, changed).otherwise(F.col("piece"))
    return joined.select("_row", F.struct("i", whole.alias("piece")).alias("p"), F.coalesce("n", F.lit(0)).alias("n")).groupBy("_row").agg(
        F.sort_array(F.collect_list("p")).alias("ps"), F.sum("n").alias("n_again")).select("_row", F.col("ps.piece").alias("_again"), "n_again")


def surrogates(entities: DataFrame, digests: Digests) -> DataFrame:
    """(kind, norm, sur) of distinct entities (kind, norm, gender), sur unlike all norms and all other surs of the kind.

    Of entities that draw one surrogate the first by a digest keeps it and the others draw again; only these go through
    the next round. From the draw LAST on, surrogates are tags, which collide with nothing.
    """
    spark = entities.sparkSession
    entities = materialise(entities, "entities")
    path, held = scratch_path(spark, "surrogates"), "kind string, norm string, sur string"
    taken = entities.select("kind", F.col("norm").alias("sur"))
    still = entities
    for attempt in range(LAST + 1):
        turn = materialise(drawn(still, attempt, digests), "drawn")
        free = turn.join(taken, ["kind", "sur"], "left_anti")
        if attempt:
            free = free.join(spark.read.schema(held).parquet(*[f"{path}/{i}" for i in range(attempt)]), ["kind", "sur"], "left_anti")
        won = free.groupBy("kind", "sur").agg(F.min(F.struct(F.xxhash64("norm").alias("h"), "norm")).alias("w")).select("kind", F.col("w.norm").alias("norm"), "sur")
        won.write.parquet(f"{path}/{attempt}")
        won = spark.read.schema(held).parquet(f"{path}/{attempt}")
        still = turn.join(won, ["kind", "norm"], "left_anti").drop("sur")
        if still.isEmpty():
            break
    return spark.read.schema(held).parquet(*[f"{path}/{i}" for i in range(attempt + 1)])


def _known_gender(norm: Column) -> Column:
    """The gender of a given name in the list."""
    out = F
    for g in "mfn":
        out = out.when(norm.isin(*[f"{script}|{n.lower()}" for (script, of), names in FIRST.items() if of == g for n in names]), g)
    return out.otherwise(F.lit(None).cast("string"))


def pseudonymise(df: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """df with its text replaced and n_entities and kinds (sorted, distinct) added.

    The key is a parameter or the setting tracemark.pii.key; without one there is an error. Null texts stay null and
    hold nothing. Overlapping candidates go to the one that begins first, then to the first type of KINDS. The same
    entity gets the same surrogate in all rows for one key and one table. A given name's gender is that of the list, else
    that of the titles before it in the table, if they agree. Names are found after a title (in any case), where they
    begin with a given name of the list, and where a word of such a name stands alone in the same text with a capital (an ordinary word
    that is written like it goes too). Other names are not found, nor are addresses and dates. Rows that repeat an id, or are wholly equal, are told apart by a
    row number. An empty table gives an empty table; own columns replace such names in df. The jobs that find entities
    and check surrogates run when this is called.
    """
    digests = Digests(key_of(df.sparkSession, key))
    df = without(df, "n_entities", "kinds", "_row", "_found", "_again", "n_again", "_new", "_pieces")
    names = df.columns
    held = materialise(df.withColumns({"_row": F.monotonically_increasing_id(), "_found": find(F.col(text_col))}), "found")
    none = held.filter(F.size("_found") == 0).select(*names, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    some = held.filter(F.size("_found") > 0)
    mentions = some.select("_row", F.posexplode("_found").alias("at", "entity")).withColumn("kind", kind_of(F.col("entity")))
    parts = mentions.select("_row", "at", "kind", "entity", title_gender(F.col("entity")).alias("g"), F.posexplode(parts_of(F.col("kind"), F.col("entity"))).alias("j", "p"))
    parts = materialise(parts.select("_row", "at", "j", F.col("kind").alias("of"), "entity", "g", "p.kind", "p.norm"), "mentions")
    told = F.when(F.count_distinct("g") == 1, F.max("g")).otherwise("n")
    entities = parts.filter("kind <> 'initial'").groupBy("kind", "norm").agg(told.alias("g")).select(
        "kind", "norm", F.coalesce(_known_gender(F.col("norm")), "g").alias("gender"))
    table = surrogates(entities, digests)
    met = materialise(join_hot(parts, table, ["kind", "norm"], "left"), "met")
    again = mentioned_again(some, met, text_col)
    shown = met.repartition("_row").groupBy("_row", "at", "of", "entity").agg(F.array_sort(F.collect_list(F.struct("j", "sur"))).alias("s"))
    shown = shown.select("_row", "of", F.struct("at", render(F.col("of"), F.col("entity"), F.col("s.sur"), digests).alias("new")).alias("m"))
    by_row = shown.groupBy("_row").agg(F.sort_array(F.collect_list("m")).alias("ms"), F.sort_array(F.collect_set("of")).alias("kinds"))
    joined = some.join(by_row.select("_row", F.col("ms.new").alias("_new"), "kinds"), "_row").join(again, "_row", "left").withColumn("_pieces", F.coalesce("_again", F.split(F.col(text_col), ANY, -1)))
    whole = F.array_join(F.transform("_pieces", lambda p, i: F.concat(p, F.coalesce(F.get("_new", i), F.lit("")))), "")
    changed = joined.withColumn(text_col, whole).select(*names, (F.size("_new") + F.coalesce("n_again", F.lit(0))).cast("long").alias("n_entities"), "kinds")
    return none.unionByName(changed)


def op7(docs: DataFrame) -> DataFrame:
    """The key comes from the session; where it has none, a public one is named here, for a query that anyone can repeat."""
    key = docs.sparkSession.conf.get(KEY_SETTING, "public example key")
    return pseudonymise(docs.select("doc_id", "text"), key=key).select("doc_id", "text", "n_entities", "kinds")
