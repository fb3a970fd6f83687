"""Messages of several contents: leaving out kinds, taking payloads out and putting them back, and the shapes of services.

Messages are arrays of (role, content), contents arrays of (type, value) with the types text, image, audio and video.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MESSAGES = "array<struct<role:string,content:array<struct<type:string,value:string>>>>"
MEDIA = ("image", "audio", "video")
_DATA = r"^data:([^;,]+);base64,"


def _each(messages: Column, change) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), change(m["content"]).alias("content")))


def without(messages: Column, *kinds: str) -> Column:
    """Messages without contents of these types; null contents are empty."""
    empty = F.array().cast("array<struct<type:string,value:string>>")
    return _each(messages, lambda c: F.coalesce(F.filter(c, lambda x: ~x["type"].isin(*kinds)), empty))


def stripped(messages: Column) -> Column:
    """Messages whose media have no values."""
    return _each(messages, lambda c: F.transform(c, lambda x: F.struct(x["type"].alias("type"), F.when(~x["type"].isin(*MEDIA), x["value"]).alias("value"))))


def rehydrated(messages: Column, full: Column) -> Column:
    """Messages whose missing values come from the content at the same place of ``full``, if that has the same type."""

    def fill(content: Column, i: Column) -> Column:
        other = lambda j: F.get(F.get(full, i)["content"], j)
        return F.transform(content, lambda x, j: F.struct(x["type"].alias("type"), F.coalesce(x["value"], F.when(other(j)["type"] == x["type"], other(j)["value"])).alias("value")))

    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), fill(m["content"], i).alias("content")))


def query_text(messages: Column) -> Column:
    """Texts of the last message of the user, one a line; null without one."""
    last = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))
    return F.when(last.isNotNull(), F.array_join(F.transform(F.filter(last["content"], lambda c: (c["type"] == "text") & c["value"].isNotNull()), lambda c: c["value"]), "\n"))


def system_text(messages: Column) -> Column:
    """Texts of the system, one a line; null without any."""
    texts = F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: F.transform(F.filter(m["content"], lambda c: c["type"] == "text"), lambda c: c["value"])))
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def _mime(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, _DATA, 1), F.lit(""))


def _payload(value: Column) -> Column:
    return F.regexp_replace(value, _DATA, "")


def _json(**fields: Column | str) -> Column:
    """JSON of a struct; fields that are null are left out."""
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _put(around: str, inner: Column) -> Column:
    """A JSON text around another one."""
    before, after = around.split("%")
    return F.concat(F.lit(before), inner, F.lit(after))


def chat_completions(messages: Column) -> Column:
    """JSON of messages with contents of the types text, image_url, input_audio and video_url."""

    def one(c: Column) -> Column:
        v = c["value"]
        return (
            F.when(c["type"] == "text", _json(type="text", text=v))
            .when(c["type"] == "audio", _put('{"type":"input_audio","input_audio":%}', _json(data=_payload(v), format=F.coalesce(F.regexp_extract(_mime(v), r"/(?:x-)?([a-z0-9]+)", 1), F.lit("wav")))))
            .otherwise(F.concat(F.lit('{"type":"'), c["type"], F.lit('_url","'), c["type"], F.lit('_url":'), _json(url=v), F.lit("}")))
        )

    said = lambda m: F.concat(F.lit('{"role":'), _quoted(m["role"]), F.lit(',"content":'), _listed(F.transform(m["content"], one)), F.lit("}"))
    return _listed(F.transform(messages, said))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def source_blocks(messages: Column) -> Column:
    """(system, messages): the system's text apart; JSON with media as blocks of a base64 or url source."""

    def one(c: Column) -> Column:
        v = c["value"]
        source = F.when(_mime(v).isNotNull(), _json(type="base64", media_type=_mime(v), data=_payload(v))).otherwise(_json(type="url", url=v))
        return F.when(c["type"] == "text", _json(type="text", text=v)).otherwise(F.concat(F.lit('{"type":'), _quoted(c["type"]), F.lit(',"source":'), source, F.lit("}")))

    rest = F.filter(messages, lambda m: m["role"] != "system")
    said = lambda m: F.concat(F.lit('{"role":'), _quoted(F.when(m["role"] == "assistant", "assistant").otherwise("user")), F.lit(',"content":'), _listed(F.transform(m["content"], one)), F.lit("}"))
    return F.struct(system_text(messages).alias("system"), _listed(F.transform(rest, said)).alias("messages"))


def model_parts(messages: Column) -> Column:
    """(system, contents): the system's text apart; JSON with the roles user and model, and parts of text, data or a file's address."""

    def one(c: Column) -> Column:
        v = c["value"]
        data = F.when(_mime(v).isNotNull(), _put('{"inline_data":%}', _json(mime_type=_mime(v), data=_payload(v)))).otherwise(_put('{"file_data":%}', _json(file_uri=v)))
        return F.when(c["type"] == "text", _json(text=v)).otherwise(data)

    rest = F.filter(messages, lambda m: m["role"] != "system")
    said = lambda m: F.concat(F.lit('{"role":'), _quoted(F.when(m["role"] == "assistant", "model").otherwise("user")), F.lit(',"parts":'), _listed(F.transform(m["content"], one)), F.lit("}"))
    return F.struct(system_text(messages).alias("system"), _listed(F.transform(rest, said)).alias("contents"))


def template_messages(messages: Column) -> Column:
    """JSON for chat templates of model repositories: media by their kind alone, their values in a list of their own order.

    Returns (messages, media).
    """

    def one(c: Column) -> Column:
        return F.when(c["type"] == "text", _json(type="text", text=c["value"])).otherwise(_json(type=c["type"]))

    said = lambda m: F.concat(F.lit('{"role":'), _quoted(m["role"]), F.lit(',"content":'), _listed(F.transform(m["content"], one)), F.lit("}"))
    media = F.flatten(F.transform(messages, lambda m: F.filter(m["content"], lambda c: c["type"].isin(*MEDIA))))
    return F.struct(_listed(F.transform(messages, said)).alias("messages"), media.alias("media"))
