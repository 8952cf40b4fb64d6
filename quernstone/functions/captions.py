"""Caption clean-up and assembly as column expressions.

Patterns use ASCII classes unless `unicode` is asked for, so that other engines agree.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The openers that captions of vision models start with, in order.
OPENERS = (
    r"this\s+(?:image|photo|picture|crop)\s+(?:is\s+|shows?\s+|depicts?\s+|features?\s+)?",
    r"the\s+(?:image|photo|picture|crop)\s+(?:is\s+|shows?\s+|depicts?\s+|features?\s+)?",
    r"the\s+shot\s+type\s+is\s+(?:an?\s+)?",
    r"an?\s+(?:cropped\s+|close[\s-]?up\s+|colou?r\s+|black[\s-]and[\s-]white\s+)*(?:image|photo(?:graph)?|picture|portrait|shot|crop)\s+of\s+",
    r"(?:cropped|close[\s-]?up)\s+(?:image|photo(?:graph)?|picture|portrait|shot)\s+of\s+",
    r"there\s+(?:is|are)\s+",
    r"it\s+(?:is|shows)\s+",
    r"we\s+(?:can\s+)?see\s+",
    r"in\s+this\s+(?:image|photo|picture|crop)\s*,?\s*",
    r"here\s+(?:is|we\s+see)\s+",
    r"sure[,!.]?\s*",
    r"caption\s*:\s*",
    r"description\s*:\s*",
)
PEEL = r"^\s*(?:" + "|".join(OPENERS) + ")+"
# Openings that keep their capital (an acronym, or two capitalised words), and commas in a row.
NAMES = r"^(?:[A-Z]{2,}|[A-Z][a-z]+\s+[A-Z])"
COMMAS = r"\s*,(?:\s*,)+"

# Names of framings by label, and limits of the padding for faces.
SHOTS = {"person": "full body shot", "upper": "upper body shot", "torso": "torso shot", "legs": "shot of the legs", "hands": "shot of the hands"}
FACE_SHOTS = ((0.35, "portrait"), (0.75, "head and shoulders portrait"))
WIDE_FACE_SHOT = "upper body portrait"
# Turns of the head by the share of the eye span.
TURNS = ((0.12, "facing the camera"), (0.30, "head turned slightly to the "), (0.55, "head turned to the "))
FULL_TURN = "head in near profile to the "
PROFILE = "in profile"
# Light by mean luma, tone by mean saturation.
LIGHTS = ((0.25, "dim low-key lighting"), (0.45, "moody lighting"), (0.68, "even lighting"))
FULL_LIGHT = "bright lighting"
TONES = ((0.05, "black and white"), (0.14, "muted desaturated colors"), (0.30, "natural colors"))
FULL_TONE = "vivid saturated colors"
SIDE_LIGHT, CONTRAST = 0.09, 0.26


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column, unicode: bool = False) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+" if unicode else r"\s+", " "))


def clean(text: Column, unicode: bool = False, rounds: int = 3) -> Column:
    """Without openers, peeled `rounds` times (one pass already takes a whole stack of them)."""
    out = squeeze(text, unicode)
    for _ in range(rounds):
        out = F.ltrim(F.regexp_replace(out, ("(?iu)" if unicode else "(?i)") + PEEL, ""))
    return lower_first(F.trim(out))


def lower_first(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    lowered = F.concat(F.lower(first), F.substring(text, 2, 1 << 30))
    return F.when((first != F.lower(first)) & ~text.rlike(NAMES), lowered).otherwise(text)


def drop(text: Column, patterns: Sequence[str]) -> Column:
    """Without what each pattern matches, in any case."""
    for pattern in patterns:
        re.compile(pattern)
    return reduce(lambda out, p: F.regexp_replace(out, f"(?i){p}", ""), patterns, text)


def dedupe(text: Column) -> Column:
    """Comma-separated phrases, each once: the first of those alike but for case and final full stops."""
    phrases = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    keyed = F.transform(phrases, lambda p, i: F.struct(F.regexp_replace(F.lower(p), r"\.+$", "").alias("key"), i.alias("place"), p.alias("phrase")))
    # sorted by key and place, the first of each key is kept; then back in their places
    first = let(F.array_sort(keyed), lambda s: F.filter(s, lambda x, i: (i == 0) | (x["key"] != F.get(s, i - 1)["key"])))
    placed = F.array_sort(F.transform(first, lambda x: F.struct(x["place"].alias("place"), x["phrase"].alias("phrase"))))
    return F.array_join(placed["phrase"], ", ")


def tidy(text: Column) -> Column:
    """Commas and white space once each; no commas, semicolons or full stops at the ends."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COMMAS, ",")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = F.regexp_replace(out, r"^[ ,;]+|[ ,;]+$", "")
    return F.trim(F.regexp_replace(out, r"\.+$", ""))


def cut(text: Column, most: int) -> Column:
    """At most `most` characters, ended at a comma; 0: all."""
    if not most:
        return text
    short = F.regexp_replace(F.substring(text, 1, most), r"(?s)^(.*),[^,]*$", "$1")
    return F.when(F.length(text) > most, F.regexp_replace(F.trim(short), r",+$", "")).otherwise(text)


def assemble(described: Column, trigger: str = "", prefix: str = "", suffix: str = "", patterns: Sequence[str] = (), most: int = 0) -> Column:
    body = dedupe(tidy(drop(clean(described), patterns)))
    parts = [F.lit(p) for p in (trigger, prefix) if p] + [F.nullif(body, F.lit(""))] + ([F.lit(suffix)] if suffix else [])
    return cut(tidy(F.concat_ws(", ", *parts)), most)


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its {tokens} filled in; unknown tokens are an error on the driver."""
    parts = []
    for text, token, *_ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if token is not None:
            if token not in values:
                raise ValueError(f"no token {token!r}; there are {', '.join(sorted(values))}")
            parts.append(F.coalesce(values[token], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _steps(measure: Column, steps: Sequence[tuple[float, str]], last: Column | str, inclusive: bool = False) -> Column:
    out = None
    for limit, name in steps:
        test = measure <= limit if inclusive else measure < limit
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def shot_type(label: Column, padding: float) -> Column:
    face = _steps(F.lit(padding), FACE_SHOTS, WIDE_FACE_SHOT, inclusive=True)
    known = F.create_map(*[F.lit(x) for pair in SHOTS.items() for x in pair])
    return F.when(label.isin("face", "head"), face).otherwise(F.coalesce(known[label], F.concat(label, F.lit(" shot"))))


def head_pose(label: Column, left_x: Column, right_x: Column, nose_x: Column) -> Column:
    """Empty without all three marks, and for whole images."""
    span = F.abs(left_x - right_x)
    offset = (nose_x - (left_x + right_x) / 2.0) / F.nullif(span, F.lit(0.0))
    side = F.when(offset > 0, "left").otherwise("right")
    far = F.abs(offset)
    (front, facing), (slight, slightly), (much, turned) = TURNS
    pose = F.when(far < front, facing).when(far < slight, F.concat(F.lit(slightly), side)).when(far < much, F.concat(F.lit(turned), side)).otherwise(F.concat(F.lit(FULL_TURN), side))
    missing = left_x.isNull() | right_x.isNull() | nose_x.isNull() | (label == "image")
    return F.when(missing, "").when(span < 1e-3, PROFILE).otherwise(pose)


def lighting(mean: Column, spread: Column, left: Column, right: Column) -> Column:
    level = _steps(mean, LIGHTS, FULL_LIGHT)
    lean = left - right
    extra = F.when(F.abs(lean) > SIDE_LIGHT, F.when(lean > 0, " from the left").otherwise(" from the right")).when(spread > CONTRAST, " with strong contrast").otherwise("")
    return F.concat(level, extra)


def tone(saturation: Column) -> Column:
    return _steps(saturation, TONES, FULL_TONE)
