import random

import pytest

from loomwright.sources import datasources, turtle

TEXT = '''@prefix ex: <http://e/> .
@base <http://base/> .
# a comment with . and [ and """
ex:a ex:p "one. [two" , """long . text
with "quotes" . ] and
@prefix ex: <http://wrong/> .
lines"""@en ;
   ex:q [ ex:r ( 1 2.5 "x" ) ; ex:s [ ex:t ex:b.c ] ] .
<rel#> a ex:Type . ex:x ex:y ex:z.
PREFIX ex: <http://other/>
ex:d ex:p """a"""^^ex:kind , 1e5 , true .
@prefix
   new:
   <http://new/> .
new:a new:b ( ) , ( ex:one [ new:c "é.ü" ] ) .
_:named ex:p _:anon-x .
[] ex:last "end" .
'''  # noqa: E501


def whole(text):
    return sorted(map(str, datasources.triples(text)))


@pytest.mark.parametrize("size", [1, 7, 40, 100, 333, 10**6])
def test_any_split_gives_the_same_triples(spark, tmp_path, size):
    (tmp_path / "a.ttl").write_text(TEXT, newline="")
    (tmp_path / "b.ttl").write_text("", newline="")
    got = turtle.read_turtle(spark, [str(tmp_path / "a.ttl"), str(tmp_path / "b.ttl")], size)
    assert sorted(str(tuple(r)) for r in got.collect()) == whole(TEXT)


def test_random_texts(spark, tmp_path):
    """Statements of random kinds over many lines, split at random sizes; each file has its own blank nodes."""
    rng = random.Random(8)
    paths, want = [], []
    for n in range(3):
        lines = ["@prefix ex: <http://e/> ."]
        for i in range(60):
            lines += rng.choice([
                [f"ex:s{i} ex:p [ ex:q", f"  ex:o{i} ; ex:r (1 2", " [ ex:d 4 ] ) ] ."],
                [f'ex:s{i} ex:p """. [', '( "" . ', f'{i}""" .'],
                [f"ex:s{i} ex:p ex:a.b, 'x' .".replace("'", '"'), "# . ["],
                [f"@prefix ex: <http://e{i}/> ."],
                [f"[ ex:p {i} ] ex:q ( )", "."],
            ])
        text = "\n".join(lines) + "\n"
        path = tmp_path / f"{n}.ttl"
        path.write_text(text, newline="")
        paths.append(str(path))
        want += whole(text)
    for size in (17, 150, 1000):
        assert sorted(str(tuple(r)) for r in turtle.read_turtle(spark, paths, size).collect()) == sorted(want)


def test_broken_texts_fail(spark, tmp_path):
    for i, text in enumerate(['@prefix e: <http://e/> .\ne:a e:b [ e:c "x" .\n', 'e:a e:b e:c .\n', '@prefix e: <http://e/> .\ne:a e:b """x .\n']):
        (tmp_path / f"{i}.ttl").write_text(text)
        with pytest.raises(Exception, match="Turtle|e"):
            turtle.read_turtle(spark, str(tmp_path / f"{i}.ttl"), 20).collect()
