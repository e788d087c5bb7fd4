from .numbers import (  # noqa: F401
    abs_, add, ceil, coalesce, day, divide, eq, floor, ge, gt, hours, if_, in_, le, lt, md5,
    minutes, month, multiply, ne, not_in, now, num, number, rand, round_, seconds, sha1, sha256,
    sha384, sha512, struuid, subtract, timezone, tz, uuid, year,
)
from .strings import (  # noqa: F401
    bnode, bound, concat, contains, datatype, encode_for_uri, iri, is_blank, is_iri, is_literal,
    is_numeric, key_values, lang, lang_matches, lcase, normalize_key, regex, replace, same_term,
    slug, str_, strafter, strbefore, strdt, strends, strlang, strlen, strstarts, substr, text,
    ucase,
)
