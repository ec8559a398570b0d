"""The English stemmer (Porter2) for DuckDB, step by step from the published description.

It shares nothing with the library's: suffix tables and exceptions are stated again here.
Tokens hold no apostrophes, so the steps for them are left out."""

# Fixed values of the published algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
_SECOND = [("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", "")]
_THIRD = [("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", "")]
_FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
_REGION = "^.*?[aeiouy][^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _mapped(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"


def _ending(suffixes) -> str:
    """The longest of the suffixes: a match that ends at the end and begins leftmost."""
    return "(" + "|".join(suffixes) + ")$"


def _suffix(name: str, before: str, suffixes) -> str:
    """x with its ending s and what stands before it, b."""
    return f"{name} AS (SELECT *, left(x, length(x) - length(s)) AS b FROM (SELECT *, regexp_extract(x, '{_ending(suffixes)}') AS s FROM {before}))"


def stems(words: str) -> str:
    """CTEs that end in stems(t, stem), for every word t of the given CTE."""
    whole, kept = ", ".join(f"'{w}'" for w in _WHOLE), ", ".join(f"'{w}'" for w in _KEPT)
    return f"""st0 AS (SELECT t, regexp_replace(t, '(^|[aeiouy])y', '\\1Y', 'g') AS x FROM (SELECT DISTINCT t FROM {words})),
st1 AS (SELECT *, CASE WHEN regexp_matches(x, '^(gener|commun|arsen)') THEN length(regexp_extract(x, '^(gener|commun|arsen)'))
    WHEN regexp_matches(x, '{_REGION}') THEN length(regexp_extract(x, '{_REGION}')) ELSE length(x) END AS r1 FROM st0),
st2 AS (SELECT *, CASE WHEN regexp_matches(substr(x, r1 + 1), '{_REGION}') THEN r1 + length(regexp_extract(substr(x, r1 + 1), '{_REGION}')) ELSE length(x) END AS r2 FROM st1),
st3 AS (SELECT t, r1, r2, CASE WHEN ends_with(x, 'sses') THEN left(x, length(x) - 2)
    WHEN ends_with(x, 'ied') OR ends_with(x, 'ies') THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
    WHEN ends_with(x, 's') AND NOT ends_with(x, 'us') AND NOT ends_with(x, 'ss') AND regexp_matches(left(x, length(x) - 2), '[aeiouy]') THEN left(x, length(x) - 1) ELSE x END AS x FROM st2),
{_suffix('st4', 'st3', ['eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'])},
st5 AS (SELECT t, r1, r2, x AS early, CASE WHEN s = '' THEN x WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE x END
    WHEN NOT regexp_matches(b, '[aeiouy]') THEN x WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1)
    WHEN r1 >= length(b) AND regexp_matches(b, '{_SHORT}') THEN b || 'e' ELSE b END AS x FROM st4),
st6 AS (SELECT t, r1, r2, early, CASE WHEN length(x) > 2 AND regexp_matches(x, '[^aeiouy][yY]$') THEN left(x, length(x) - 1) || 'i' ELSE x END AS x FROM st5),
{_suffix('st7', 'st6', [a for a, _ in _SECOND])},
st8 AS (SELECT t, r1, r2, early, CASE WHEN s = '' OR length(b) < r1 OR (s = 'li' AND NOT regexp_matches(b, '[cdeghkmnrt]$')) OR (s = 'ogi' AND NOT ends_with(b, 'l')) THEN x
    ELSE b || {_mapped('s', _SECOND)} END AS x FROM st7),
{_suffix('st9', 'st8', [a for a, _ in _THIRD])},
st10 AS (SELECT t, r1, r2, early, CASE WHEN s = '' OR length(b) < r1 OR (s = 'ative' AND length(b) < r2) THEN x ELSE b || {_mapped('s', _THIRD)} END AS x FROM st9),
{_suffix('st11', 'st10', _FOURTH)},
st12 AS (SELECT t, r1, r2, early, CASE WHEN s = '' OR length(b) < r2 OR (s = 'ion' AND NOT regexp_matches(b, '[st]$')) THEN x ELSE b END AS x FROM st11),
st13 AS (SELECT t, early, CASE WHEN ends_with(x, 'e') AND (length(x) - 1 >= r2 OR (length(x) - 1 >= r1 AND NOT regexp_matches(left(x, length(x) - 1), '{_SHORT}'))) THEN left(x, length(x) - 1)
    WHEN ends_with(x, 'll') AND length(x) - 1 >= r2 THEN left(x, length(x) - 1) ELSE x END AS x FROM st12),
stems AS (SELECT t, CASE WHEN length(t) <= 2 THEN t WHEN t IN ({whole}) THEN {_mapped('t', _WHOLE.items())} WHEN early IN ({kept}) THEN early ELSE replace(x, 'Y', 'y') END AS stem FROM st13)"""
