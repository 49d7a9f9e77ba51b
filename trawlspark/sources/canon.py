"""The book dimension and the tag dimensions as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

# Books in canonical order, with testament and genre.
BOOKS = (
    ("Genesis", "창세기", "OT", "모세오경"),
    ("Exodus", "출애굽기", "OT", "모세오경"),
    ("Leviticus", "레위기", "OT", "모세오경"),
    ("Numbers", "민수기", "OT", "모세오경"),
    ("Deuteronomy", "신명기", "OT", "모세오경"),
    ("Joshua", "여호수아", "OT", "역사서"),
    ("Judges", "사사기", "OT", "역사서"),
    ("Ruth", "룻기", "OT", "역사서"),
    ("1Samuel", "사무엘상", "OT", "역사서"),
    ("2Samuel", "사무엘하", "OT", "역사서"),
    ("1Kings", "열왕기상", "OT", "역사서"),
    ("2Kings", "열왕기하", "OT", "역사서"),
    ("1Chronicles", "역대상", "OT", "역사서"),
    ("2Chronicles", "역대하", "OT", "역사서"),
    ("Ezra", "에스라", "OT", "역사서"),
    ("Nehemiah", "느헤미야", "OT", "역사서"),
    ("Esther", "에스더", "OT", "역사서"),
    ("Job", "욥기", "OT", "시가서"),
    ("Psalms", "시편", "OT", "시가서"),
    ("Proverbs", "잠언", "OT", "시가서"),
    ("Ecclesiastes", "전도서", "OT", "시가서"),
    ("SongofSolomon", "아가", "OT", "시가서"),
    ("Isaiah", "이사야", "OT", "대예언서"),
    ("Jeremiah", "예레미야", "OT", "대예언서"),
    ("Lamentations", "예레미야애가", "OT", "대예언서"),
    ("Ezekiel", "에스겔", "OT", "대예언서"),
    ("Daniel", "다니엘", "OT", "대예언서"),
    ("Hosea", "호세아", "OT", "소예언서"),
    ("Joel", "요엘", "OT", "소예언서"),
    ("Amos", "아모스", "OT", "소예언서"),
    ("Obadiah", "오바댜", "OT", "소예언서"),
    ("Jonah", "요나", "OT", "소예언서"),
    ("Micah", "미가", "OT", "소예언서"),
    ("Nahum", "나훔", "OT", "소예언서"),
    ("Habakkuk", "하박국", "OT", "소예언서"),
    ("Zephaniah", "스바냐", "OT", "소예언서"),
    ("Haggai", "학개", "OT", "소예언서"),
    ("Zechariah", "스가랴", "OT", "소예언서"),
    ("Malachi", "말라기", "OT", "소예언서"),
    ("Matthew", "마태복음", "NT", "복음서"),
    ("Mark", "마가복음", "NT", "복음서"),
    ("Luke", "누가복음", "NT", "복음서"),
    ("John", "요한복음", "NT", "복음서"),
    ("Acts", "사도행전", "NT", "역사서"),
    ("Romans", "로마서", "NT", "바울서신"),
    ("1Corinthians", "고린도전서", "NT", "바울서신"),
    ("2Corinthians", "고린도후서", "NT", "바울서신"),
    ("Galatians", "갈라디아서", "NT", "바울서신"),
    ("Ephesians", "에베소서", "NT", "바울서신"),
    ("Philippians", "빌립보서", "NT", "바울서신"),
    ("Colossians", "골로새서", "NT", "바울서신"),
    ("1Thessalonians", "데살로니가전서", "NT", "바울서신"),
    ("2Thessalonians", "데살로니가후서", "NT", "바울서신"),
    ("1Timothy", "디모데전서", "NT", "바울서신"),
    ("2Timothy", "디모데후서", "NT", "바울서신"),
    ("Titus", "디도서", "NT", "바울서신"),
    ("Philemon", "빌레몬서", "NT", "바울서신"),
    ("Hebrews", "히브리서", "NT", "일반서신"),
    ("James", "야고보서", "NT", "일반서신"),
    ("1Peter", "베드로전서", "NT", "일반서신"),
    ("2Peter", "베드로후서", "NT", "일반서신"),
    ("1John", "요한일서", "NT", "일반서신"),
    ("2John", "요한이서", "NT", "일반서신"),
    ("3John", "요한삼서", "NT", "일반서신"),
    ("Jude", "유다서", "NT", "일반서신"),
    ("Revelation", "요한계시록", "NT", "예언서"),
)

# Tags of books.
BOOK_TAGS = (
    ("Psalms", "위로 탄식 찬양 감사 기쁨 슬픔 두려움 평안 외로움 절망 하나님의 사랑 보호하심 은혜"),
    ("Proverbs", "지혜 결단 인도하심 올바른 길 훈계 관계 말 교만 겸손 부지런함"),
    ("Job", "고난 시련 인내 의심 고통 회복 하나님의 주권 억울함"),
    ("Ecclesiastes", "허무 인생의 의미 지혜 공허함 하나님 만족"),
    ("SongofSolomon", "사랑 관계 헌신 아름다움"),
    ("Isaiah", "위로 소망 구원 새 힘 두려워하지 말라 회복 새로운 시작 인도하심 구속"),
    ("Jeremiah", "소망 회복 언약 미래 계획 하나님의 계획"),
    ("Lamentations", "슬픔 탄식 회복 소망 고난 자비"),
    ("Ezekiel", "회복 새로운 마음 소망 하나님의 영광"),
    ("Daniel", "담대함 믿음 하나님의 주권 핍박 승리"),
    ("Hosea", "사랑 회복 용서 돌아옴"),
    ("Jonah", "도피 회개 용서 하나님의 자비"),
    ("Matthew", "사랑 은혜 치유 용서 구원 천국 믿음 염려하지 말라"),
    ("Mark", "치유 기적 믿음 구원 즉각적 행동"),
    ("Luke", "은혜 자비 치유 용서 소외된 자 기쁨 낮은 자"),
    ("John", "사랑 영생 빛 믿음 하나님의 사랑 평안 위로 보혜사"),
    ("Romans", "은혜 구원 믿음 평안 소망 담대함 하나님의 사랑 고난 중 소망"),
    ("1Corinthians", "사랑 은사 믿음 공동체 부활 소망"),
    ("2Corinthians", "위로 고난 은혜 능력 회복 자족"),
    ("Galatians", "자유 은혜 믿음 성령의 열매"),
    ("Ephesians", "은혜 하나님의 사랑 공동체 기도 전신갑주 담대함"),
    ("Philippians", "기쁨 감사 평안 자족 담대함 만족 염려하지 말라"),
    ("Colossians", "감사 새로운 삶 평안 그리스도 중심"),
    ("1Thessalonians", "소망 위로 재림 격려 믿음"),
    ("2Thessalonians", "인내 소망 담대함"),
    ("1Timothy", "믿음 기도 지도력 경건"),
    ("2Timothy", "담대함 믿음 인내 끝까지"),
    ("Hebrews", "믿음 인내 소망 완성 구름 같은 증인"),
    ("James", "시련 인내 지혜 믿음 행함 기도"),
    ("1Peter", "고난 소망 인내 위로 나그네 삶"),
    ("2Peter", "성장 말씀 믿음"),
    ("1John", "사랑 빛 하나님의 사랑 용서 확신"),
    ("Revelation", "소망 승리 위로 재림 인내 영원"),
)

# Tags of genres. A genre that comes twice takes its last entry.
GENRE_TAGS = (
    ("모세오경", "믿음 순종 언약 창조 구원 인도하심 하나님의 신실하심"),
    ("역사서", "인도하심 승리 믿음 실패 회복 하나님의 신실하심 순종"),
    ("시가서", "위로 찬양 감사 기쁨 슬픔 탄식 지혜 사랑 평안 두려움"),
    ("대예언서", "회개 소망 구원 위로 심판 회복 새로운 시작 두려워하지 말라"),
    ("소예언서", "회개 심판 소망 인도하심 회복 하나님께로 돌아옴"),
    ("복음서", "사랑 은혜 치유 용서 구원 영생 기쁨 믿음 염려하지 말라"),
    ("역사서", "담대함 성령 선교 박해 믿음 공동체"),
    ("바울서신", "은혜 평안 사랑 믿음 소망 감사 위로 담대함 기쁨 자족"),
    ("일반서신", "믿음 시련 인내 소망 겸손 위로 사랑"),
    ("예언서", "소망 승리 재림 인내 위로 영원"),
)


def book_rows() -> list[tuple[int, str, str, str, str]]:
    """(book_ord, book_en, ko, testament, genre), 66 of them."""
    return [(at, *book) for at, book in enumerate(BOOKS)]


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(book_rows(), schemas.BOOKS)


def book_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BOOK_TAGS), schemas.TAGS)


def genre_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(dict(GENRE_TAGS).items()), schemas.TAGS)
