from needledrop.functions.calendar import (
    calendar_day,
    floor_div,
    micros,
    release_year,
    seconds_of_day,
    wall_clock,
    with_temporal_features,
)
from needledrop.functions.scalars import (
    NUMBER,
    as_salted_key,
    label_flag,
    lenient_float,
    platform_family,
    presence_flag,
    song_age,
    track_id,
)

__all__ = [
    "NUMBER",
    "as_salted_key",
    "calendar_day",
    "floor_div",
    "label_flag",
    "lenient_float",
    "micros",
    "platform_family",
    "presence_flag",
    "release_year",
    "seconds_of_day",
    "song_age",
    "track_id",
    "wall_clock",
    "with_temporal_features",
]
