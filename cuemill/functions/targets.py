"""What an input names: a video, a list, a channel, a post or a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import let, trim

#: Fixed values.
CHANNEL_TABS = ["videos", "shorts", "streams", "live", "featured", "playlists", "community", "about", "search"]
VIDEO_ID = r"^[A-Za-z0-9_-]{11}\z"
LIST_ID = r"^[A-Za-z0-9_-]+\z"
HANDLE = r"^@[A-Za-z0-9_.-]+\z"
URL = r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?(?:[/]([^?#]*))?(?:\?([^#]*))?(?:#.*)?\z"
STATUS = r"^(i/web|[A-Za-z0-9_]+)/status/(\d+)(?:/(video|photo)/([1-9]\d*))?/?\z"
HOSTS = r"^(?:youtu\.be|(?:.+\.)?youtube\.com|t\.co|(?:(?:www|m|mobile)\.)?(?:x|twitter)\.com)\z"
SITE = "https://www.youtube.com/"
#: What a user is told, before the input itself.
REFUSED = "No video, list, channel or post is known by this name: "
NO_SUBTITLES = "Live talks have no captions that could be read: "

_FIELDS = {"kind": "string", "url": "string", "video_id": "string", "video_number": "int", "path": "string", "error": "string"}


def _target(**values: Column) -> Column:
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FIELDS.items()])


def _video(candidate: Column, refused: Column) -> Column:
    found = _target(kind=F.lit("video"), url=F.concat(F.lit(SITE + "watch?v="), candidate), video_id=candidate)
    return F.when(candidate.rlike(VIDEO_ID), found).otherwise(refused)


def _channel(segments: Column) -> Column:
    tab = F.lower(F.element_at(segments, -1)).isin(CHANNEL_TABS)
    path = F.array_join(segments, "/")
    return _target(kind=F.lit("channel"), url=F.concat(F.lit(SITE), path, F.when(tab, "").otherwise("/videos")))


def parse_target(text: Column, playlist: bool = False) -> Column:
    """struct<kind, url, video_id, video_number, path, error> of an input string.

    A url that names a video and a list is the video, unless the list is asked for. What names nothing
    known has an error and no kind. The url of a target names that target again.
    """
    whole = F.coalesce(text, F.lit(""))
    refused = _target(error=F.concat(F.lit(REFUSED), whole))

    def of(typed: Column) -> Column:
        address = F.when(typed.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), typed).otherwise(F.concat(F.lit("https://"), typed))
        group = lambda n: F.regexp_extract(address, URL, n)
        given = lambda name: F.regexp_extract(F.concat(F.lit("&"), group(3)), f"&{name}=([^&]*)", 1)
        parameter = lambda name: F.coalesce(F.try_url_decode(given(name)), given(name))
        named = F.regexp_replace(F.lower(group(1)), r"^www\.", "")
        parts = F.struct(
            F.when(address.rlike(URL) & named.rlike(HOSTS), F.regexp_replace(named, r"^(?:m|mobile)\.(?=(?:x|twitter)\.com\z)", "")).alias("host"),
            group(2).alias("path"),
            F.filter(F.split(group(2), "/"), lambda s: s != "").alias("segments"),
            parameter("list").alias("list"),
            parameter("v").alias("v"),
        )
        return (
            F.when(typed == "", refused)
            .when(typed.rlike(r"(?i)\.vtt\z"), _target(kind=F.lit("file"), path=typed))
            .when(typed.rlike(HANDLE), _channel(F.array(typed)))
            .when(typed.rlike(VIDEO_ID), _video(typed, refused))
            .otherwise(let(parts, lambda p: _from_url(p, whole, refused, playlist)))
        )

    return let(trim(whole), of)


def _from_url(p: Column, whole: Column, refused: Column, playlist: bool) -> Column:
    host, path, segments = p["host"], p["path"], p["segments"]
    first = F.coalesce(F.get(segments, 0), F.lit(""))
    listed = F.when(p["list"].rlike(LIST_ID), _target(kind=F.lit("playlist"), url=F.concat(F.lit(SITE + "playlist?list="), p["list"]))).otherwise(refused)
    group = lambda n: F.regexp_extract(path, STATUS, n)
    address = F.concat(F.lit("https://"), host, F.lit("/"))
    selected = F.when(group(3) != "", F.concat(F.lit("/"), group(3), F.lit("/"), group(4))).otherwise("")
    number = F.coalesce(F.nullif(group(4), F.lit("")).cast("int"), F.lit(1))
    post = _target(kind=F.lit("post"), url=F.concat(address, group(1), F.lit("/status/"), group(2), selected), video_number=number)
    short = _target(kind=F.lit("post"), url=F.concat(address, F.regexp_replace(path, "/\\z", "")), video_number=F.lit(1))
    of_video = _video(p["v"], refused)
    if playlist:
        of_video = F.when(p["list"] != "", listed).otherwise(of_video)
    return (
        F.when(host.isNull(), refused)
        .when(host == "t.co", F.when(path.rlike(r"^[A-Za-z0-9]+/?\z"), short).otherwise(refused))
        .when(host.rlike(r"^(?:www\.)?(?:x|twitter)\.com\z"), F.when(path.rlike("^i/(?:broadcasts|events|spaces)/"), _target(error=F.concat(F.lit(NO_SUBTITLES), whole))).when(path.rlike(STATUS), post).otherwise(refused))
        .when(host == "youtu.be", _video(first, refused))
        .when(first == "watch", of_video)
        .when(first == "shorts", _video(F.coalesce(F.get(segments, 1), F.lit("")), refused))
        .when(first == "playlist", listed)
        .when(first.rlike(HANDLE) | (first.isin("channel", "c", "user") & (F.size(segments) > 1)), _channel(segments))
        .otherwise(refused)
    )
