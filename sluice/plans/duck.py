"""DuckDB expressions for the text functions, written on their own from what the functions mean."""

from __future__ import annotations

from sluice.functions.fingerprints import LOW_ENTROPY_SKELETONS, SENTINELS
from sluice.functions.links import STRONG, TRAILING
from sluice.sources.bindings import RELATIONS, TABLES

_SPACE = r"[\s\x{3000}\x{a0}]+"
_W = r"[\p{L}\p{N}_]"
_URL = r"(?:https?://|www\.)[^\s<>()\[\]{}\"'']+"
_FULL, _HALF = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " "


def every(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def bare(x: str) -> str:
    return every(x, r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]")


def squeeze(x: str) -> str:
    return f"trim({every(x, _SPACE, ' ')})"


def normalize(x: str) -> str:
    plain = every(f"translate({bare(x)}, '{_FULL}', '{_HALF}')", r"\p{So}")
    return squeeze(every(f"lower({plain})", r"\p{Nd}"))


def skeleton(x: str) -> str:
    x = f"lower({bare(x)})"
    x = every(x, rf"(^|[^\p{{L}}\p{{N}}_]){_URL}", r"\1 <url> ")
    x = every(x, rf"(^|[^\p{{L}}\p{{N}}_]){_W}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_.-]+\.[a-z]{{2,}}\b", r"\1 <email> ")
    x = every(x, rf"(^|[^\p{{L}}\p{{N}}_])@{_W}{{3,}}", r"\1 <mention> ")
    x = squeeze(every(every(x, r"\p{So}"), r"\p{Nd}"))
    tokens = f"regexp_extract_all({x}, '<url>|<email>|<mention>|[\\x{{4e00}}-\\x{{9fff}}]+|[a-z_]+|[^ ]')"
    shapes = f"list_transform({tokens}, lambda t: CASE WHEN regexp_full_match(t, '[a-z_]+') THEN '<w>' ELSE t END)"
    # A run of one placeholder is written once; lag within the list by zipping it with itself.
    pairs = f"list_zip({shapes}, list_prepend('', {shapes})[1:-2])"
    return f"array_to_string(list_transform(list_filter({pairs}, lambda p: NOT (p[1] = p[2] AND starts_with(p[1], '<'))), lambda p: p[1]), ' ')"


def digest(x: str) -> str:
    return f"left(sha256({x}), 32)"


def mentions(x: str) -> str:
    return f"len(regexp_extract_all({x}, '(^|[^\\p{{L}}\\p{{N}}_])@{_W}{{3,}}'))"


def punctuation_only(clean: str) -> str:
    return f"NOT regexp_matches({clean}, '[\\p{{L}}\\p{{N}}]')"


def low_text(clean: str) -> str:
    cjk = f"length({every(clean, r'[^\x{4e00}-\x{9fff}]')})"
    return f"({cjk} < 3 AND length({every(clean, '[^a-zA-Z0-9]')}) < 4)"


def low_skeleton(x: str) -> str:
    rest = every(x, r"<[\p{L}\p{N}_]+>|[^\p{L}\p{N}]+")
    return f"({x} IN ({quoted(LOW_ENTROPY_SKELETONS)}) OR length({rest}) < 3)"


def meaningful(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} NOT IN ({quoted(SENTINELS)}))"


def canonical(x: str) -> str:
    cut = f"trim(trim({x}), '{TRAILING.replace(chr(39), chr(39) * 2)}')"
    return f"CASE WHEN starts_with({cut}, 'www.') THEN concat('https://', {cut}) ELSE {cut} END"


def domain(x: str) -> str:
    """Of any url, which is made canonical first."""
    host = f"lower(trim(regexp_extract({canonical(x)}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)', 1), '[]'))"
    return f"nullif({every(f'rtrim({host}, {chr(39)}.{chr(39)})', '^www\\.')}, '')"


def links(x: str, preview: str = "NULL", entity: str = "NULL") -> str:
    """A list of {url, source, domain}, of equal urls the first."""
    found = f"list_transform(regexp_extract_all({x}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({_URL})', 1), lambda u: {{'url': {canonical('u')}, 'source': 'text', 'domain': {domain(canonical('u'))}}})"
    more = f"CASE WHEN {preview} IS NOT NULL AND {preview} <> '' THEN [{{'url': {canonical(preview)}, 'source': 'preview', 'domain': {domain(canonical(preview))}}}] ELSE [] END"
    linked = f"CASE WHEN {entity} IS NOT NULL AND {entity} <> '' THEN [{{'url': {canonical(entity)}, 'source': 'entity', 'domain': {domain(canonical(entity))}}}] ELSE [] END"
    whole = f"list_concat({found}, {more})" if entity == "NULL" else f"list_concat(list_concat({found}, {linked}), {more})"
    return f"list_filter({whole}, lambda l, i: l.url <> '' AND list_position(list_transform({whole}, lambda m: m.url), l.url) = i)"


def preview(links_: str) -> str:
    """The first link that only the preview has."""
    return f"list_filter({links_}, lambda l: l.source = 'preview')[1].url"


def domains(links_: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({links_}, lambda l: l.domain), lambda d: d IS NOT NULL)))"


def strong(clean: str) -> str:
    return f"regexp_matches({clean}, '{'|'.join(STRONG)}')"


def carrier(x: str, links_: str, mentions_: str, preview: str) -> str:
    names = f"regexp_matches({x}, '@{_W}{{3,}}') OR regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){_W}{{3,}}bot($|[^\\p{{L}}\\p{{N}}_])') OR regexp_matches({x}, '(?i)https?://|t\\.me/')"
    return f"({mentions_} > 0 OR len({links_}) > 0 OR {preview} OR {names})"


def spam_bio(bio: str) -> str:
    return f"coalesce(regexp_matches({bio}, '(?i)https?://|t\\.me/|telegram|@{_W}{{3,}}') AND {strong(normalize(bio))}, false)"


def with_(*names: str) -> str:
    """A WITH clause of relations, and of `features` where asked for."""
    out = []
    for name in names:
        out.append(f"{name} AS ({EXTRA[name] if name in EXTRA else RELATIONS[name].format(**{t: t for t in TABLES})})")
    return "WITH " + ",\n".join(out) + "\n"


EXTRA = {
    # Steps in turn, so that each text is normalised once.
    "texts": f"SELECT *, {normalize('text')} AS clean, {skeleton('text')} AS skeleton, {links('text', 'preview_url')} AS links, {mentions('text')} AS mentions FROM messages",
    "features": f"""SELECT *, {digest("clean")} AS content_hash, {digest("skeleton")} AS skeleton_hash, {punctuation_only("clean")} AS punctuation_only,
      {preview("links")} IS NOT NULL AS has_preview, {preview("links")} AS preview_link, {carrier("text", "links", "mentions", f"{preview('links')} IS NOT NULL")} AS carrier, {strong("clean")} AS strong FROM texts""",
}
