"""Romanised names back in Cyrillic."""

import pytest

from quillgraph.functions.names import fold
from quillgraph.functions.to_cyrillic import cyrillic, to_cyrillic

NAMES = """Mikhail=Михаил Nikolai=Николай Shcherbakov=Щербаков Tsvetkova=Цветкова Petrova-Sidorova=Петрова-Сидорова Yuri=Юрий Li=Ли Dmitriy=Дмитрий
Zaytsev=Зайцев Zaitsev=Зайцев Voytenko=Войтенко Seyfullin=Сейфуллин Nikolayev=Николаев Sergeyev=Сергеев Vasilyev=Васильев Grigoryev=Григорьев Ulyanov=Ульянов
Lukyanov=Лукьянов Kasyanov=Касьянов Tretyakov=Третьяков Dyakonov=Дьяконов Kudryavtseva=Кудрявцева Ryabov=Рябов Myasnikov=Мясников Kolyubin=Колюбин Klyuev=Клюев
Yevgeny=Евгений Rudyi=Рудый Bezrodnyi=Безродный Ilyina=Ильина Ilya=Илья Ilja=Илья Iliya=Илья Tatyana=Татьяна Alexander=Александр Aleksandr=Александр Pyotr=Пётр
Vyacheslav=Вячеслав Lyubov=Любовь Nikita=Никита Zhukov=Жуков Musaev=Мусаев Sergey=Сергей Maria=Мария IVANOV=ИВАНОВ ivanov=иванов Иванов=Иванов"""


@pytest.mark.parametrize("pair", NAMES.split())
def test_words(pair):
    latin, want = pair.split("=")
    assert to_cyrillic(latin) == want


def test_initials_parts_and_spaces():
    assert to_cyrillic("S.S. Rudyi") == "С.С. Рудый"
    assert to_cyrillic("I.Yu. Nikitin") == "И.Ю. Никитин"
    assert to_cyrillic("A.V.Petrov") == "А.В.Петров"
    assert to_cyrillic("  Wei   Wang ") == "Вей Ванг"
    assert (to_cyrillic(None), to_cyrillic("")) == (None, "")


def test_regular_names_come_back():
    for name in "ivanov petrov zhukov shcherbakov tsvetkova khlebnikov chernov bazarov ryabov klyuev romanov".split():
        assert fold(to_cyrillic(name)) == name


def test_column(spark):
    rows = spark.createDataFrame([("Olga Ilina",), (None,), ("",), ("Olga Ilina",)], "n string").select(cyrillic("n").alias("c")).collect()
    assert [r.c for r in rows] == ["Ольга Илина", None, "", "Ольга Илина"]
