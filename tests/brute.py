"""The detection rules once more, one buffer at a time in plain Python, as a yardstick for the tests."""

import codecs
import math
import unicodedata


def text_like(text):
    head = text[:500]
    if not head or any(unicodedata.category(c) == "Co" for c in head):
        return False
    good = sum(1 for c in head if c in "\r\n\t" or unicodedata.category(c) != "Cc")
    return good / len(head) >= 0.9


def strict(data, codec):
    if codec == "utf-8" and len(data) > 1 and data[-2] == 0xED and 0xA0 <= data[-1] <= 0xBF:
        return None  # a surrogate can never be completed
    try:
        return codecs.getincrementaldecoder(codec)("strict").decode(data, False)
    except UnicodeError:
        return None


def valid(data, codec):
    text = strict(data, codec)
    return text is not None and text_like(text)


def entropy(data):
    return -sum(data.count(b) / len(data) * math.log2(data.count(b) / len(data)) for b in set(data))


def detect(data):
    data = data[:65536]
    if not data or (len(data) >= 512 and entropy(data) > 7.4):
        return "(Unknown)", False
    for name, mark in [("utf-32", "FFFE0000"), ("utf-32BE", "0000FEFF"), ("utf-8", "EFBBBF"),
                       ("utf-16", "FFFE"), ("utf-16BE", "FEFF")]:
        if data.startswith(bytes.fromhex(mark)):
            return name, True
    quads = data[: len(data) // 4 * 4]
    if len(quads) >= 16:
        if not any(quads[3::4]) and valid(quads, "utf-32-le"):
            return "utf-32", False
        if not any(quads[0::4]) and valid(quads, "utf-32-be"):
            return "utf-32BE", False
    pairs = data[: len(data) // 2 * 2]
    if len(pairs) >= 10:
        order = utf16_order(pairs[0::2], pairs[1::2])
        if order and valid(pairs, "utf-16-le" if order == "utf-16" else "utf-16-be"):
            return order, False
    if all(b in (9, 10, 13) or 0x20 <= b <= 0x7E for b in data):
        return "us-ascii", False
    if valid(data, "utf-8"):
        return "utf-8", False
    return "(Unknown)", False


def utf16_order(even, odd):
    units = len(even)
    be, le = even.count(0) / units, odd.count(0) / units
    if be > 0.5 and le < 0.1:
        return "utf-16BE"
    if le > 0.5 and be < 0.1:
        return "utf-16"
    if be < 0.02 and le < 0.02:
        return None
    expected = units / 256
    chi = [0.0, 0.0]
    for i, channel in enumerate((even, odd)):
        for b in range(256):  # added up one by one: the built-in sum() compensates rounding
            off = channel.count(b) - expected
            chi[i] += off * off / expected
    if chi[1] >= 300 and chi[1] > chi[0]:
        return "utf-16"
    if chi[0] >= 300 and chi[0] > chi[1]:
        return "utf-16BE"
    return None
