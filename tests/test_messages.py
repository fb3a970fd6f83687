"""Messages of several contents and the shapes of services."""

import json

import pytest
from pyspark.sql import functions as F

from scorewright.functions import messages as msg

PNG, URL = "data:image/png;base64,QUJD", "https://x.y/a.jpg"
CHAT = [
    ("system", [("text", 'Be "short".\n')]),
    ("user", [("image", PNG), ("text", "What é?"), ("image", URL)]),
    ("assistant", [("text", "A\\B")]),
    ("user", [("audio", "data:audio/x-wav;base64,UklG"), ("video", URL), ("text", "And"), ("text", "this?")]),
]
ROWS = [(1, CHAT), (2, []), (3, None), (4, [("user", [("text", None)])]), (5, [("user", [])])]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(ROWS, f"i int, m {msg.MESSAGES}")


def got(chats, column):
    return {r.i: r.x for r in chats.select("i", column.alias("x")).collect()}


def test_kinds_go_and_come_back(chats):
    m = F.col("m")
    left = got(chats, msg.without(m, "image", "video"))
    assert [[c.type for c in x.content] for x in left[1]] == [["text"], ["text"], ["text"], ["audio", "text", "text"]] and left[2] == [] and left[3] is None
    bare = got(chats, msg.stripped(m))
    assert [c.value for c in bare[1][1].content] == [None, "What é?", None]
    back = got(chats, msg.rehydrated(msg.stripped(m), m))
    assert back[1] == got(chats, m)[1]
    moved = got(chats, msg.rehydrated(msg.stripped(m), msg.without(m, "audio")))
    assert [c.value for c in moved[1][3].content] == [None, None, "And", "this?"]  # other kinds stand at these places


def test_texts(chats):
    assert got(chats, msg.query_text(F.col("m"))) == {1: "And\nthis?", 2: None, 3: None, 4: "", 5: ""}
    assert got(chats, msg.system_text(F.col("m"))) == {1: 'Be "short".\n', 2: None, 3: None, 4: None, 5: None}


def test_shapes_of_services(chats):
    m = F.col("m")
    chat = json.loads(got(chats, msg.chat_completions(m))[1])
    assert chat[0] == {"role": "system", "content": [{"type": "text", "text": 'Be "short".\n'}]}
    assert chat[1]["content"][0] == {"type": "image_url", "image_url": {"url": PNG}}
    assert chat[3]["content"][0] == {"type": "input_audio", "input_audio": {"data": "UklG", "format": "wav"}}
    blocks = got(chats, msg.source_blocks(m))[1]
    said = json.loads(blocks.messages)
    assert blocks.system == 'Be "short".\n' and [x["role"] for x in said] == ["user", "assistant", "user"]
    assert said[0]["content"][0]["source"] == {"type": "base64", "media_type": "image/png", "data": "QUJD"} and said[0]["content"][2]["source"] == {"type": "url", "url": URL}
    parts = json.loads(got(chats, msg.model_parts(m))[1].contents)
    assert [x["role"] for x in parts] == ["user", "model", "user"] and parts[1]["parts"] == [{"text": "A\\B"}]
    assert parts[0]["parts"][0] == {"inline_data": {"mime_type": "image/png", "data": "QUJD"}} and parts[0]["parts"][2] == {"file_data": {"file_uri": URL}}
    shaped = got(chats, msg.template_messages(m))[1]
    assert json.loads(shaped.messages)[1]["content"] == [{"type": "image"}, {"type": "text", "text": "What é?"}, {"type": "image"}]
    assert [c.type for c in shaped.media] == ["image", "image", "audio", "video"]


def test_empty_and_null_messages(chats):
    assert {k: v for k, v in got(chats, msg.chat_completions(F.col("m"))).items() if k != 1} == {2: "[]", 3: None, 4: '[{"role":"user","content":[{"type":"text"}]}]', 5: '[{"role":"user","content":[]}]'}
    assert got(chats, msg.model_parts(F.col("m")))[5].contents == '[{"role":"user","parts":[]}]'
