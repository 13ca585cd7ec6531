from factloom.operators.tables import columns, header_depth, read_rows, typed

TABLES = {
    "two": [["№", "Наименование", "Ед.", "Показатель", "Примечание"], ["п/п", "показателя", "изм.", "по проекту", ""], ["1", "2", "3", "4", "5"], ["", "Дом", "", "", ""], ["1", "Площадь застройки", "м", "1 200,5", "см. лист"],
            ["2", "Высота", "м", "12", "—"], ["", "Двор", "", "", ""], ["3", "Площадь двора", "м", "300", ""]],
    "none": [["101", "Коридор общий", "12,5"], ["102", "Комната", "8"], ["103а", "Кладовая тёмная", "-"]],
    "numbers": [["1", "2"], ["5", "6"]],
    "label": [["Наименование", "Величина"]],
}


def cells(spark):
    rows = [(t, r, c, text) for t, grid in TABLES.items() for r, row in enumerate(grid) for c, text in enumerate(row)]
    return spark.createDataFrame(rows, "t string, r int, c int, text string")


def test_headers_of_two_rows_and_a_numbering(spark):
    got = {r.t: (r.labels, r.depth) for r in header_depth(typed(cells(spark)), ["t"]).collect()}
    assert got == {"two": (2, 3), "none": (0, 0), "numbers": (0, 2), "label": (1, 1)}


def test_roles_by_header_and_by_cells(spark):
    got = {}
    for r in columns(cells(spark), ["t"]).orderBy("t", "c").collect():
        got.setdefault(r.t, []).append((r.title, r.role))
    assert got["two"] == [("№ · п/п", "number"), ("Наименование · показателя", "name"), ("Ед. · изм.", "unit"), ("Показатель · по проекту", "value"), ("Примечание", "text")]
    assert [role for _, role in got["none"]] == ["number", "name", "value"]
    assert [role for _, role in got["label"]] == ["name", "value"]


def test_rows_with_their_sections(spark):
    got = [(r.r, r.section, r.number, r.name, r.unit, [tuple(v) for v in r["values"]]) for r in read_rows(cells(spark).where("t = 'two'"), ["t"]).orderBy("r").collect()]
    head = "Показатель · по проекту"
    assert got == [(4, "Дом", "1", "Площадь застройки", "м", [(head, 1200.5)]), (5, "Дом", "2", "Высота", "м", [(head, 12.0)]), (7, "Двор", "3", "Площадь двора", "м", [(head, 300.0)])]


def test_cells_are_read_and_dealt_out_once(spark):
    for read in (columns, read_rows):
        cells = spark.createDataFrame([("t", 0, 0, "Name"), ("t", 0, 1, "Value"), ("t", 1, 0, "wall"), ("t", 1, 1, "3")], "k string, r int, c int, text string")
        plan = read(cells.repartition(3, "k"), ["k"])._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
