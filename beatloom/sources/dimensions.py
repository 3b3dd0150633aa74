"""Fixed dimensions: languages with their voices, preset voices, resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Languages with English name, direction, font, font file, own name and the usual male and female voice.
LANGUAGES = (
    ("en", "English", False, "Inter", "Inter-Regular.ttf", "English", "en-US-GuyNeural", "en-US-JennyNeural"),
    ("fr", "French", False, "Inter", "Inter-Regular.ttf", "Français", "fr-FR-HenriNeural", "fr-FR-DeniseNeural"),
    ("de", "German", False, "Inter", "Inter-Regular.ttf", "Deutsch", "de-DE-ConradNeural", "de-DE-KatjaNeural"),
    ("es", "Spanish", False, "Inter", "Inter-Regular.ttf", "Español", "es-ES-AlvaroNeural", "es-ES-ElviraNeural"),
    ("hi", "Hindi", False, "Noto Sans Devanagari", "NotoSansDevanagari-Regular.ttf", "हिन्दी", "hi-IN-SwaraNeural", "hi-IN-SwaraNeural"),
    ("ar", "Arabic", True, "Noto Sans Arabic", "NotoSansArabic-Regular.ttf", "العربية", "ar-SA-ZayedNeural", "ar-SA-ZariyahNeural"),
    ("ja", "Japanese", False, "Noto Sans JP", "NotoSansJP-Regular.ttf", "日本語", "ja-JP-KeitaNeural", "ja-JP-NanamiNeural"),
    ("ko", "Korean", False, "Noto Sans KR", "NotoSansKR-Regular.ttf", "한국어", "ko-KR-InJoonNeural", "ko-KR-SunHiNeural"),
    ("pt", "Portuguese", False, "Inter", "Inter-Regular.ttf", "Português", "pt-BR-FabioNeural", "pt-BR-ElzaNeural"),
    ("ru", "Russian", False, "Inter", "NotoSans-Regular.ttf", "Русский", "ru-RU-DmitryNeural", "ru-RU-SvetlanaNeural"),
    ("it", "Italian", False, "Inter", "Inter-Regular.ttf", "Italiano", "it-IT-DiegoNeural", "it-IT-ElsaNeural"),
    ("zh", "Chinese", False, "Noto Sans SC", "NotoSansSC-Regular.ttf", "中文", "zh-CN-YunxiNeural", "zh-CN-XiaoyiNeural"),
)

# Voices for narration by purpose.
VOICES = (("documentary_male", "en-US-GuyNeural"), ("documentary_female", "en-US-JennyNeural"), ("australian_male", "en-AU-WilliamNeural"), ("british_male", "en-GB-RyanNeural"), ("american_male", "en-US-ChristopherNeural"))

# Output resolutions.
RESOLUTIONS = (("1080p", 1920, 1080), ("720p", 1280, 720), ("4k", 3840, 2160))


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES), "code string, name string, rtl boolean, font string, font_file string, display_name string, voice string, voice_female string")


def resolutions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESOLUTIONS), "name string, width int, height int")


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VOICES), "preset string, voice string")
