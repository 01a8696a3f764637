"""Data folders and the word rule of the training-data tests."""

import os
import re

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def data(table, sf=SMALL):
    return os.path.join(sf, f"{table}.parquet")
