"""Copies on the shared folder and their end."""

import os

import pytest

from corpuskit.session import materialise, temporary_copies


def path_of(df):
    return df._copy_path.removeprefix("file:")


def test_copies_go_with_their_block_unless_kept(spark):
    with temporary_copies(spark) as outer:
        with temporary_copies(spark) as kept:
            gone, stays = materialise(spark.range(3), "a"), materialise(spark.range(4), "b")
            kept.append(stays)
        assert not os.path.exists(path_of(gone)) and os.path.exists(path_of(stays))
        assert stays.count() == 4
        last = materialise(spark.range(5), "c")
        outer.append(last)
    assert not os.path.exists(path_of(stays)) and last.count() == 5


def test_copies_go_when_a_block_fails(spark):
    with pytest.raises(RuntimeError), temporary_copies(spark) as kept:
        copy = materialise(spark.range(3), "a")
        kept.append(copy)
        raise RuntimeError
    assert not os.path.exists(path_of(copy))


def test_copies_outside_blocks_stay(spark):
    assert materialise(spark.range(3), "a").count() == 3
