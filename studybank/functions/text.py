"""Per-row text expressions (native Spark functions only).

Notes on engine differences that matter for exact results:
* Spark's ``trim`` removes spaces only; Python's ``str.strip``/``split`` use
  any Unicode whitespace.  Where the labelling convention collapses or strips
  whitespace we use ``(?U)\\s`` (Unicode-aware in Java regex).
* Java look-around is used where the convention needs it (``a/b`` -> ``a or b``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studybank import constants as K


# Whitespace as Python's str.split() sees it, written out so that Java regex
# and RE2 (the oracle) agree on it.
WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_report(c) -> Column:
    """Labeller text cleaning, in this order: lower case; ``and/or`` -> ``or``;
    letter/letter -> ``letter or letter``; ``..`` -> ``.``; a space after every
    ``.`` and ``,``; collapse and strip whitespace; drop empty sentences.

    Each pattern begins with what few characters pass: most of a labeller's time on the JVM goes into these."""
    t = F.lower(_col(c))
    t = F.replace(t, F.lit("and/or"), F.lit("or"))
    t = F.regexp_replace(t, r"/(?<=[a-zA-Z]/)(?=[a-zA-Z])", " or ")
    t = F.replace(t, F.lit(".."), F.lit("."))
    t = F.regexp_replace(t, r"[.,]", "$0 ")
    t = F.regexp_replace(t, "[[^!-~]&&" + WS + "]+", " ")
    t = F.trim(t)
    t = F.regexp_replace(t, r"\. +\.", ".")
    return t


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading / trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), "^" + WS + "+|" + WS + "+$", "")


def strip_newlines(c, repl: str = "") -> Column:
    """Delete (or replace) ``\\n`` and ``\\r``; words on either side join."""
    if repl == "":
        return F.translate(_col(c), "\n\r", "")
    return F.regexp_replace(_col(c), "[\n\r]", repl)


def alnum_tokens(c) -> Column:
    """Non ``[0-9a-zA-Z ]`` runs become a space, then split on whitespace."""
    cleaned = F.regexp_replace(_col(c), "[^0-9a-zA-Z ]+", " ")
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def has_letters(c) -> Column:
    return _col(c).rlike("[A-Za-z]")


def template(c, fmt: str = K.CAPTION_TEMPLATE) -> Column:
    return F.format_string(fmt, _col(c))


def file_stem(c) -> Column:
    """Last path segment without its final extension."""
    return F.regexp_extract(_col(c), r"([^/]*?)(\.[^./]*)?$", 1)


def parent_stem(c) -> Column:
    """Name of the folder holding the file."""
    return F.regexp_extract(_col(c), r"([^/]*)/[^/]*$", 1)


def rewrite_root(c, root: str, suffix: str = "_res") -> Column:
    """Replace the root folder segment ``root`` by ``root + suffix``."""
    import re as _re
    return F.regexp_replace(_col(c), "^" + _re.escape(root.rstrip("/")) + "(?=/|$)",
                            root.rstrip("/").replace("\\", "\\\\").replace("$", "\\$") + suffix)


def normalise_section(c) -> Column:
    """Canonical section name: exact spelling map, else the first main name it
    contains, else ``findings`` if it names the whole study, else unchanged."""
    name = F.lower(F.btrim(_col(c), F.lit(" \t\n\r\f\u000b")))
    mapping = F.create_map(*[F.lit(x) for kv in K.SECTION_NAME_MAP.items() for x in kv])
    out = F.element_at(mapping, name)
    main = None
    for m in K.MAIN_SECTIONS:
        cond = F.instr(name, m) > 0
        main = F.when(cond, F.lit(m)) if main is None else main.when(cond, F.lit(m))
    import re as _re
    study_wide = "(" + "|".join(_re.escape(t) for t in K.STUDY_WIDE_TERMS) + ")"
    return F.coalesce(
        F.when(out.isNotNull(), out),
        main.otherwise(F.lit(None)),
        F.when(name.rlike(study_wide), F.lit("findings")),
        name,
    )
