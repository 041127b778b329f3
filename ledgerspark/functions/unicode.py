"""Functions that need Unicode's compatibility forms or a URL's percent encoding: Arrow batches, each a small helper."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import TRACKING, TRACKING_PREFIX


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form, full case folding, runs of white space one space; null stays null."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()), na_action="ignore")


def _destination(url: str) -> str:
    raw = unicodedata.normalize("NFKC", url).strip()
    at = urlsplit(f"https:{raw}" if raw.startswith("//") else raw)
    try:
        port = at.port
    except ValueError:
        return raw
    if not at.netloc:
        return raw if raw == "/" else raw.rstrip("/")
    host = (at.hostname or "").casefold()
    host = f"[{host}]" if ":" in host else host
    user, mark, _ = at.netloc.rpartition("@")
    usual = {"http": 80, "https": 443}.get(at.scheme)
    place = f"{user}{mark}{host}{'' if port is None or port == usual else f':{port}'}"
    counts = lambda name: name.strip().casefold().startswith(TRACKING_PREFIX) or name.strip().casefold() in TRACKING
    query = urlencode([(k, v) for k, v in parse_qsl(at.query, keep_blank_values=True) if not counts(k)])
    return urlunsplit((at.scheme, place, at.path.rstrip("/") if at.path not in ("", "/") else "/", query, ""))


@F.pandas_udf(StringType())
def destination(url: pd.Series) -> pd.Series:
    """text.destination with compatibility forms and one percent encoding of parameters."""
    return url.map(_destination, na_action="ignore")


def revision(dropped: tuple[str, ...]):
    """A function of JSON objects as text: the SHA-256 of the object, without keys in dropped at any depth, keys in order."""

    def scrub(x):
        if isinstance(x, dict):
            return {k: scrub(v) for k, v in x.items() if k not in dropped}
        return [scrub(v) for v in x] if isinstance(x, list) else x

    def of(rows: pd.Series) -> pd.Series:
        digest = lambda t: hashlib.sha256(json.dumps(scrub(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        return rows.map(digest, na_action="ignore")

    return F.pandas_udf(of, StringType())
