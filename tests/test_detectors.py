"""The reference's example lists: positives, negatives, masks and tokens."""
from pyspark.sql import functions as F

from spanshield.functions import formats as FM
from spanshield.functions import masks as M
from spanshield.operators.detect import detect, explode_detections
from spanshield.operators.rewrite import tokenize


def _types(spark, text):
    df = spark.createDataFrame([(1, text)], "msg_id long, body string")
    return [(r.type, r.text) for r in explode_detections(detect(df, "body"), keep=["msg_id"]).collect()]


def test_secret_in_json(spark):
    assert ("SECRET", "sk-1234567890abcdef") in _types(spark, '{"api_key": "sk-1234567890abcdef", "text": "hello"}')


def test_bearer_key(spark):
    assert [t for t, _ in _types(spark, "Authorization: Bearer sk-abc123xyz-secret")] == ["SECRET"]


def test_names(spark):
    for text in ["Привет, я Иван Иванов из отдела разработки", "Петров Пётр Сергеевич отвечает за проект",
                 "Мария Петрова подготовила отчёт", "Документ подписал Александр Смирнов"]:
        assert "PII_FIO" in [t for t, _ in _types(spark, text)], text


def test_non_names(spark):
    for text in ["Обзор Личного кабинета", "Описание Статуса заказа", "Перерыв Перерыв", "Канал Связи Внутренний",
                 "Требует Авторизации", "Назначен Автоматически"]:
        assert _types(spark, text) == [], text


def test_emails_and_service_addresses(spark):
    assert _types(spark, "мой email: user@company.com, пишите") == [("PII_EMAIL", "user@company.com")]
    for text in ["root@server.example.com", "postgres@db.internal.org", "git@github.com:user/repo.git",
                 "deploy@192.168.1.5.nip.io"]:
        assert _types(spark, text) == [], text
    assert _types(spark, "john.doe@gmail.com") == [("PII_EMAIL", "john.doe@gmail.com")]
    # Unicode word boundary: the span starts after the accented letter run
    assert _types(spark, "éa.b@x.com") == [("PII_EMAIL", ".b@x.com")]


def test_phones(spark):
    for text in ["+7 999 123-45-67", "8 921 555-44-33", "8 812 345-67-89"]:
        assert _types(spark, f"тел {text} ok") == [("PII_PHONE", text)]
    for text in ["8 123 456-78-90", "81234567890", "8 156 789-01-23"]:
        assert _types(spark, text) == [], text


def test_no_false_positives(spark):
    assert _types(spark, "See api-reference documentation for details") == []
    assert _types(spark, "Просто обычный текст без секретов и персональных данных") == []
    assert _types(spark, "") == []


def test_masks(spark):
    df = spark.createDataFrame([("sk-1234567890abcdef", "user@company.com", "Иван Иванов", "+7 999 123-45-67",
                                 "api_key=secret123abcdef", "ab", "ООО «Ромашка»")],
                               "s string, e string, f string, p string, kv string, short string, c string")
    r = df.select(M.mask_secret(F.col("s")).alias("s"), M.mask_email(F.col("e")).alias("e"),
                  M.mask_fio(F.col("f")).alias("f"), M.mask_phone(F.col("p")).alias("p"),
                  M.mask_secret_kv(F.col("kv")).alias("kv"), M.mask_secret(F.col("short")).alias("short"),
                  M.mask_company(F.col("c")).alias("c")).first()
    assert r.s == "sk-1234***-cdef"
    assert r.e == "u***@c***.com"
    assert r.f == "Иван И***"
    assert r.p == "+7 ***-**-4567"
    assert r.kv == "api_key=secre***-cdef"
    assert r.short == "***"
    assert r.c == "ООО «Р***"


def test_tokens_deterministic_and_session_scoped(spark):
    rows = [(1, "u1", "api.deepseek.com", "key sk-abcdefghij1234567890"),
            (2, "u1", "api.deepseek.com", "key sk-abcdefghij1234567890"),
            (3, "u2", "api.deepseek.com", "key sk-abcdefghij1234567890")]
    df = spark.createDataFrame(rows, "msg_id long, user_id string, host string, body string")
    t = {r.msg_id: r.tokenized for r in tokenize(df, "body").collect()}
    assert t[1] == t[2] and t[1] != t[3]
    assert t[1].startswith("key [KEY_") and t[1].endswith("]")


def test_formatters(spark):
    df = spark.createDataFrame([(0,), (512,), (1024,), (1536,), (1048576,), (1073741824,)], "b long")
    assert [r[0] for r in df.select(FM.format_bytes(F.col("b"))).collect()] == \
        ["0 B", "512 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 GB"]
    df = spark.createDataFrame([(0,), (999,), (1000,), (1500,), (1000000,)], "t long")
    assert [r[0] for r in df.select(FM.format_tokens(F.col("t"))).collect()] == ["0", "999", "1.0K", "1.5K", "1.0M"]
    df = spark.createDataFrame([(0.0,), (50.0,), (100.0,)], "p double")
    assert [r[0] for r in df.select(FM.progress_bar(F.col("p"))).collect()] == \
        ["░░░░░░░░", "████░░░░", "████████"]
    df = spark.createDataFrame([(None,), (7,)], "v long")
    assert [r[0] for r in df.select(FM.format_optional(F.col("v"))).collect()] == ["∞", "7"]
