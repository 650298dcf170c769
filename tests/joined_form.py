"""The per-family form of the hourly rollup: levels left-joined to registration, ads and purchases."""

from playerlytics.operators import clean, rollup


def hourly_rollup_joined(player_info, behavior):
    levels = rollup.family_hourly(clean.clean_levels(behavior), "level")
    ads = rollup.family_hourly(clean.clean_ads(behavior), "ad")
    purchases = rollup.family_hourly(clean.clean_purchases(behavior), "purchase")
    reg = rollup.registration(clean.clean_players(player_info))
    return rollup.finish_hourly(levels.join(reg, list(rollup.USER_KEYS), "left")
                                .join(ads, list(rollup.HOUR_KEYS), "left")
                                .join(purchases, list(rollup.HOUR_KEYS), "left"))
