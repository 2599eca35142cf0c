"""Text expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Function words of English and Italian that content terms leave out (our own list).
STOP = tuple(
    "the and for with that this from are was were been have has had not but you your they them their its our out into over than then when where which who will would can could "
    "una uno gli dei del della delle degli nel nella con per che non come sono era anche questo questa quello quella dal dalla alla allo alle".split()
)
#: Substrings that mark a negation (fixed values; a marker counts wherever it occurs).
NEGATIONS = ("not", "no", "never", "without", "cannot", "n't", "non", "mai", "senza", "nessun", "né")


def terms(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def token_estimate(text: Column) -> Column:
    """Words cost 1 and one more for every 4 letters over 6; every other sign that isn't white space costs 1; at least 1."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    cost = F.aggregate(words, F.lit(0), lambda s, w: s + 1 + F.floor(F.greatest(F.lit(0), F.length(w) - 6) / 4).cast("int"))
    return F.greatest(F.lit(1), cost + F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]"))).cast("long")


def content_terms(text: Column) -> Column:
    """Terms of over two bytes, apostrophes kept inside, without stop words."""
    # Apostrophes at the ends of words go first, so that one split gives the words.
    words = F.split(F.regexp_replace(text, r"(?<![\p{L}\p{N}'])'+|'+(?![\p{L}\p{N}'])", " "), r"[^\p{L}\p{N}']+")
    return F.filter(F.transform(words, F.lower), lambda x: (F.octet_length(x) > 2) & ~x.isin(*STOP))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def negations(text: Column) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(m)).cast("int") for m in NEGATIONS), F.lit(0))


def leading_number(text: Column, decimal: bool = False) -> Column:
    """Number at the start of the first word that begins with a digit; ``decimal`` asks for a point in it."""
    found = F.regexp_extract(text, r"(?:^|\s)(\d+(?:\.\d+)?)", 1)
    good = (found != "") & (F.contains(found, F.lit(".")) if decimal else F.lit(True))
    return F.when(good, found.cast("double"))


def entity_key(text: Column) -> Column:
    """Outer signs trimmed (hyphens stay), lower case, spaces to hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^[^\p{L}\p{N}-]+|[^\p{L}\p{N}-]+$", "")), " ", "-")


def name_tokens(name: Column) -> Column:
    """Parts of an identifier: at - _ . / space and where lower case meets upper case."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2")), r"[-_./ ]+"), lambda x: x != "")


def segments(text: Column, least_words: int = 3) -> Column:
    """Parts between full stops, line breaks and semicolons, trimmed, of at least so many words."""
    parts = F.transform(F.split(text, r"[.\n;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.size(F.split(x, r"\s+")) >= least_words)


#: Names of manifests and extensions of each kind of file (fixed values).
MANIFESTS = ("Cargo.toml", "package.json", "pom.xml", "build.gradle", "build.gradle.kts", "AndroidManifest.xml", "pyproject.toml", "go.mod", "Gemfile")
KINDS = {
    "doc": ("md", "rst", "adoc"),
    "asset": ("png", "jpg", "jpeg", "gif", "svg", "ico", "webp"),
    "config": ("toml", "yaml", "yml", "json", "ini", "conf", "properties", "xml"),
    "source": ("rs", "ts", "tsx", "js", "jsx", "java", "kt", "py", "go", "rb", "c", "h", "cpp", "hpp", "swift", "php", "cs"),
}


def shape_kind(path: Column) -> Column:
    """What a file of a project is, by its relative path: a manifest by name, a test by its place or stem, else by extension."""
    name = F.element_at(F.split(path, "/"), -1)
    low, stem = F.lower(path), F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    test = F.contains(low, F.lit("/test")) | F.startswith(low, F.lit("test")) | F.endswith(stem, F.lit("_test")) | F.endswith(stem, F.lit(".test"))
    kind = F.when(name.isin(*MANIFESTS), "manifest").when(test, "test")
    extension = F.regexp_extract(F.lower(name), r"\.([^.]*)$", 1)
    for k, some in KINDS.items():
        kind = kind.when(extension.isin(*some), k)
    return kind.otherwise("other")


def single_line(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def elide_middle(path: Column, most: int) -> Column:
    """A path of at most ``most`` characters: what is too much goes from the middle, the name at its end stays (and alone, if it is that long)."""
    name = F.element_at(F.split(path, "/"), -1)
    room = F.lit(most) - F.length(name) - 2
    return F.when(F.length(path) <= most, path).when(room <= 0, name).otherwise(F.concat(F.left(path, room), F.lit("…/"), name))


def structural(text: Column) -> Column:
    """Symbols between white space, as they are: a text that is a sequence of symbols is neither folded nor cut at signs."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def encode(text: Column, vocabulary: Column) -> Column:
    """Ids of the terms of a text by a map from term to id; unknown terms are left out."""
    return F.array_compact(F.transform(terms(text), lambda t: F.element_at(vocabulary, t)))


def decode(ids: Column, vocabulary: Column) -> Column:
    """Text of ids by a map from id to term, with single spaces; unknown ids are left out."""
    return F.array_join(F.array_compact(F.transform(ids, lambda i: F.element_at(vocabulary, i))), " ")
