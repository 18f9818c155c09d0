"""Sources: files, decoders on recorded frames, and network readers against loopback servers."""

import base64
import hashlib
import socket
import struct
import threading

import pytest

from sluice.sources import cbor, files, firehose, live, microblog, websocket


def test_lines_of_a_file(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes("a\r\n\nb\rc\nlast é".encode())
    assert [r.payload for r in files.text_messages(spark, str(path)).orderBy("seq").collect()] == ["a", "", "b\rc", "last é"]
    assert files.text_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.text_lines(spark, str(tmp_path / "none"), missing="raise")


def test_microblog_addresses():
    assert microblog.stream_url() == "wss://streaming.mastodon.social/api/v1/streaming?stream=public&access_token="
    assert microblog.stream_url("http://x.org:80/y", "t k") == "ws://streaming.x.org/api/v1/streaming?stream=public&access_token=t+k"
    assert microblog.stream_url("junk").startswith("ws://streaming.mastodon.social/")


def test_microblog_events(spark):
    post = '{"content": "<p>hi</p>", "created_at": "2024-01-01T00:00:00.123Z"}'
    frames = [
        {"event": "update", "payload": post},
        {"event": "delete", "payload": post},
        {"event": "update", "payload": "no json"},
        {"event": "update", "payload": post.replace("2024-01-01T", "yesterday ")},
        {"event": "update", "payload": '{"content": "x"}'},
        {"event": "update", "payload": post.replace("Z", "+02:00").replace("hi", "zone")},
    ]
    import json

    rows = spark.createDataFrame([(json.dumps(f),) for f in frames] + [("{",), (None,)], "value string")
    found = microblog.posts(rows).selectExpr("payload", "unix_millis(event_ts) ms").collect()
    assert [(r.payload, r.ms) for r in found] == [("<p>hi</p>", 1704067200123), ("<p>zone</p>", 1704067200123 - 7_200_000)]


def test_cbor_values():
    for value in (0, 23, 24, 255, 65536, 2**40, -1, -500, b"x" * 300, "é", [1, [2, "a"]], {"a": {"b": None}}, True, False, 1.5):
        assert cbor.decode(cbor.encode(value)) == value
    assert cbor.decode(b"\x9f\x01\x02\xff") == [1, 2]
    assert cbor.decode(b"\xbf\x61a\x01\xff") == {"a": 1}
    assert cbor.decode(b"\x7f\x61a\x61b\xff") == "ab"
    assert cbor.decode(b"\xd8\x2a\x41\x00") == (42, b"\x00")
    assert cbor.decode(b"\xf9\x3c\x00") == 1.0
    for bad in (b"", b"\x61", b"\x82\x01", b"\xff", b"\x1c", b"\x61\xff", b"\x81" * 500):
        with pytest.raises(cbor.DecodeError):
            cbor.decode(bad)


def test_firehose_frames(spark):
    at = "2024-01-01T00:00:00.5Z"
    good = firehose.frame("hello", at)
    assert firehose.frame_posts(good) == [("hello", 1704067200500)]
    assert firehose.frame_posts(firehose.frame("x", at, action="delete")) == []
    assert firehose.frame_posts(firehose.frame("x", at, kind="app.bsky.feed.like")) == []
    assert firehose.frame_posts(firehose.frame("x", "noon")) == []
    block = lambda t: cbor.encode({"$type": firehose.POST, "text": t, "createdAt": at})
    two = cbor.encode({}) + cbor.encode({"ops": [{"action": "create"}, {"action": "delete"}], "blocks": cbor.encode_car([block("a"), b"\xff", cbor.encode([1]), block("b")])})
    assert [t for t, _ in firehose.frame_posts(two)] == ["a", "b"]
    for bad in (b"", good[:30], cbor.encode({}) + cbor.encode({"ops": 1}), cbor.encode({}) + cbor.encode([1])):
        with pytest.raises(cbor.DecodeError):
            firehose.frame_posts(bad)
    rows = spark.createDataFrame([(good,), (good[:50],), (b"",), (None,)], "frame binary")
    assert [r.payload for r in firehose.posts(rows).collect()] == ["hello"]


class Server:
    """A WebSocket server for one connection after another; what it sends is given as raw frames."""

    def __init__(self, *connections):
        self.listener = socket.create_server(("127.0.0.1", 0))
        self.url = f"ws://127.0.0.1:{self.listener.getsockname()[1]}"
        self.requests, self.received = [], b""
        threading.Thread(target=self._run, args=(connections,), daemon=True).start()

    def _run(self, connections):
        for frames in connections:
            link, _ = self.listener.accept()
            head = b""
            while b"\r\n\r\n" not in head:
                head += link.recv(4096)
            self.requests.append(head.decode(errors="replace"))
            key = [x.split(b": ")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key")][0]
            accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest())
            link.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")
            for f in frames:
                link.sendall(f)
            # Closing with unread data would reset the connection and lose what was sent.
            link.shutdown(socket.SHUT_WR)
            link.settimeout(5)
            try:
                while link.recv(4096):
                    pass
            except OSError:
                pass
            link.close()
        self.listener.close()


def frame(data, opcode=1, final=True):
    n = len(data)
    size = bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n)
    return bytes([(128 if final else 0) | opcode]) + size + data


def test_websocket_text_frames():
    server = Server([frame(b"one"), frame("zwé".encode(), 2), frame(b"\xff\xfe", 2), frame(b"ping", 9), frame(b"pa", 1, False), frame(b"rt", 0), frame(b"x" * 300), frame(b"", 8), frame(b"late")])
    assert list(websocket.text_frames(server.url)) == ["one", "zwé", "part", "x" * 300]
    server = Server([frame(b"text"), frame(b"bytes", 2)])
    assert list(websocket.binary_frames(server.url)) == [b"bytes"]
    for bad in ("http://x", "ws://"):
        with pytest.raises(ValueError):
            websocket.WebSocket(bad)


def publish(topic, payload, number=7):
    body = websocket._text(topic) + struct.pack(">H", number) + payload
    return websocket._packet(0x32, body)


def test_mqtt_messages_and_new_connection():
    first = publish("t", b"a")
    server = Server([frame(b"\x20\x02\x00\x00", 2), frame(first[:4], 2), frame(first[4:] + publish("t", b"\xff") + publish("t", b"b" * 200), 2)], [frame(publish("t", b"c"), 2)])
    assert list(websocket.mqtt_messages(server.url, "t", "me", retry_s=0, attempts=2)) == ["a", "b" * 200, "c"]
    assert "client_id=me" in server.requests[0] and "Sec-WebSocket-Protocol: mqtt" in server.requests[1]


def test_packet_splitting():
    data = publish("t", b"x" * 1000) + b"\x20\x02\x00\x00"
    for cut in range(len(data)):
        found, rest = websocket.split_packets(data[:cut])
        more, left = websocket.split_packets(rest + data[cut:])
        assert len(found) + len(more) == 2 and left == b""


def test_socket_stream(spark, tmp_path):
    server = Server([frame(b"a"), frame(b"b"), frame(b"c")])
    query = live.stream(spark, "websocket", url=server.url, wait_ms="1500").writeStream.format("memory").queryName("socket_rows").option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(60):
            if spark.sql("select count(*) from socket_rows").first()[0] == 3 or query.exception():
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert sorted(r.payload for r in spark.sql("select payload from socket_rows").collect()) == ["a", "b", "c"]
