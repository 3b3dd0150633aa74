"""Filter strings of timeline items for a renderer: clips, stills, text cards, sound.

Numbers are written with two digits. Null texts are empty; an unknown position
of a text uses the item's own coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, HEIGHT, RATE = 1920, 1080, 30


def number(c: Column) -> Column:
    """A number with two digits, as text."""
    return F.coalesce(F.round(c, 2), F.lit(0.0)).cast("decimal(18,2)").cast("string")


def _fitted(w: int, h: int) -> str:
    return f"scale={w}:{h}:force_original_aspect_ratio=decrease,pad={w}:{h}:(ow-iw)/2:(oh-ih)/2:black"


def clip_filter(index: Column, start: Column, duration: Column, motion: Column, w: int = WIDTH, h: int = HEIGHT) -> Column:
    i = index.cast("string")
    moved = F.when(motion == "push_in_slow", f",zoompan=z='min(zoom+0.0005,1.1)':x='iw/2-(iw/zoom/2)':y='ih/2-(ih/zoom/2)':d=1:s={w}x{h}")
    moved = moved.when(motion == "pan_left", F.concat(F.lit(",crop=iw:ih:iw*0.3*t/"), number(duration), F.lit(":0"))).otherwise("")
    return F.concat(F.lit("["), i, F.lit(f":v]{_fitted(w, h)},trim=start="), number(start), F.lit(":duration="), number(duration), F.lit(",setpts=PTS-STARTPTS"), moved, F.lit(",format=yuv420p[v"), i, F.lit("]"))


def sound_filter(index: Column, begin: Column, end: Column, duration: Column) -> Column:
    """The narration's stretch of an item, null if it has none."""
    i = index.cast("string")
    text = F.concat(F.lit("["), i, F.lit(":a]atrim=start="), number(begin), F.lit(":duration="), number(duration), F.lit(",asetpts=PTS-STARTPTS[a"), i, F.lit("]"))
    return F.when((F.coalesce(begin, F.lit(0.0)) > 0) | (F.coalesce(end, F.lit(0.0)) > 0), text)


def still_filter(index: Column, duration: Column, motion: Column, w: int = WIDTH, h: int = HEIGHT, rate: int = RATE) -> Column:
    i = index.cast("string")
    frames = F.floor(F.coalesce(duration, F.lit(0.0)) * rate).cast("string")
    moved = F.when(motion == "push_in", f"zoompan=z='1+0.05*on/{rate}':x='iw/2-(iw/zoom/2)':y='ih/2-(ih/zoom/2)':d=1:s={w}x{h}:fps={rate}")
    moved = moved.when(motion == "pan_right", F.concat(F.lit("zoompan=z='1.05':x='max(iw*0.05 - iw*0.05*on/"), frames, F.lit(f",0)':y='ih/2-(ih*1.05/2)':d=1:s={w}x{h}:fps={rate}"))).otherwise(_fitted(w, h))
    return F.concat(F.lit("["), i, F.lit(":v]"), moved, F.lit(",trim=duration="), number(duration), F.lit(f",fps={rate},format=yuv420p[v"), i, F.lit("]"))


def card_filter(index: Column, text: Column, duration: Column, position: Column, x: Column, y: Column, w: int = WIDTH, h: int = HEIGHT, rate: int = RATE) -> Column:
    i = index.cast("string")
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("'"), F.lit("\\'")), F.lit(":"), F.lit("\\:"))
    place = F.when(position == "center", "x=(w-text_w)/2:y=(h-text_h)/2").when(position == "bottom", "x=(w-text_w)/2:y=h*0.85").when(position == "top", "x=(w-text_w)/2:y=h*0.1")
    place = place.otherwise(F.concat(F.lit("x=w*"), number(x), F.lit(":y=h*"), number(y)))
    return F.concat(
        F.lit(f"color=c=black:s={w}x{h}:d="), number(duration), F.lit(f":r={rate}[base];[base]drawtext=text='"), safe, F.lit("':fontcolor=white:fontsize=72:fontfile=Arial:"), place, F.lit(":box=1:boxcolor=black@0.6:boxborderw=20[v"), i, F.lit("]")
    )


def mix_filter(index: Column) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit(":a]asetpts=PTS-STARTPTS[aout]"))
