"""Rule sets: the catalogue for eight-card decks and a small one for the order adapter's baskets."""

from __future__ import annotations

from duelframe.operators.archetypes import Rule, RuleSet

# Card groups, strategic anchors, and the rules with their names, families, weights and priorities.
GROUPS = {
    "cheap_cycle": ("Bats", "Electro Spirit", "Fire Spirit", "Goblins", "Heal Spirit", "Ice Spirit", "Skeletons", "Spear Goblins", "The Log", "Zap"),
    "bridge_pressure": ("Bandit", "Battle Ram", "Cannon Cart", "Dark Prince", "Electro Wizard", "Magic Archer", "Ram Rider", "Royal Ghost"),
    "bait": ("Dart Goblin", "Goblin Barrel", "Goblin Gang", "Princess", "Rascals", "Rocket", "Skeleton Army", "Skeleton Barrel"),
    "split_lane": ("Flying Machine", "Goblin Cage", "Royal Hogs", "Royal Recruits", "Three Musketeers", "Zappies"),
    "heavy_support": ("Baby Dragon", "Dark Prince", "Electro Dragon", "Lightning", "Lumberjack", "Mega Minion", "Night Witch", "Phoenix", "Tornado"),
    "air_support": ("Balloon", "Baby Dragon", "Bats", "Flying Machine", "Inferno Dragon", "Mega Minion", "Minions", "Skeleton Dragons"),
    "defensive_building": ("Bomb Tower", "Cannon", "Goblin Cage", "Inferno Tower", "Tesla", "Tombstone"),
    "small_spell": ("Arrows", "Barbarian Barrel", "Giant Snowball", "Royal Delivery", "The Log", "Zap"),
    "big_spell": ("Earthquake", "Fireball", "Freeze", "Lightning", "Poison", "Rocket"),
}
ANCHORS = (
    "Balloon", "Battle Ram", "Electro Giant", "Elixir Golem", "Giant", "Goblin Barrel", "Goblin Drill", "Goblin Giant", "Golem", "Graveyard", "Hog Rider",
    "Lava Hound", "Mega Knight", "Miner", "Mortar", "P.E.K.K.A", "Ram Rider", "Royal Giant", "Royal Hogs", "Royal Recruits", "Three Musketeers", "X-Bow",
)
RULES = (
    Rule("野猪地震", "小费轮转", ("Hog Rider",), ("Earthquake",), (), {"Firecracker": 0.8, "Cannon": 0.5, "Tesla": 0.4}, {}, {"cheap_cycle": 0.25, "small_spell": 0.25}, 90),
    Rule("野猪速转", "小费轮转", ("Hog Rider",), (), (), {"Musketeer": 0.5, "Cannon": 0.5, "Ice Golem": 0.5}, {"Earthquake": 4.0}, {"cheap_cycle": 0.35, "small_spell": 0.2}, 40),
    Rule("皇家野猪轮转", "小费轮转", ("Royal Hogs",), (), (), {"Earthquake": 1.0, "Royal Delivery": 0.5, "Archer Queen": 0.5}, {"Royal Recruits": 5.0}, {"cheap_cycle": 0.25, "split_lane": 0.25}, 55),
    Rule("矿工消耗", "消耗控制", ("Miner",), (), (), {"Wall Breakers": 1.5, "Poison": 0.7, "Bomb Tower": 0.5, "Magic Archer": 0.4}, {"Balloon": 3.5, "Mortar": 2.5, "Lava Hound": 5.0}, {"cheap_cycle": 0.2, "defensive_building": 0.2}, 35),
    Rule("哥布林钻机控制", "消耗控制", ("Goblin Drill",), (), (), {"Wall Breakers": 0.8, "Poison": 0.7, "Fireball": 0.4, "Bomb Tower": 0.5}, {}, {"cheap_cycle": 0.2, "defensive_building": 0.2}, 60),
    Rule("诱导消耗", "消耗控制", ("Goblin Barrel", "Skeleton Barrel", "Wall Breakers"), (), (), {"Princess": 1.0, "Goblin Gang": 0.8, "Rocket": 0.7, "Rascals": 0.6, "Dart Goblin": 0.5}, {}, {"bait": 0.35, "cheap_cycle": 0.15}, 65),
    Rule("骷髅召唤控制", "消耗控制", ("Graveyard",), (), (), {"Poison": 0.8, "Freeze": 0.7, "Baby Dragon": 0.5, "Tombstone": 0.4}, {"Giant": 1.5}, {"defensive_building": 0.15, "big_spell": 0.2}, 50),
    Rule("X连弩自闭", "建筑自闭", ("X-Bow",), (), (), {"Tesla": 1.0, "Archers": 0.5, "Knight": 0.4, "Fireball": 0.3}, {}, {"cheap_cycle": 0.3, "defensive_building": 0.35}, 100),
    Rule("迫击炮消耗", "建筑自闭", ("Mortar",), (), (), {"Skeleton Barrel": 0.8, "Miner": 0.7, "Cannon Cart": 0.6, "Rascals": 0.5}, {}, {"cheap_cycle": 0.2, "bait": 0.2}, 95),
    Rule("皮卡桥头冲锋", "桥头冲锋", ("P.E.K.K.A",), (), ("Battle Ram", "Ram Rider", "Bandit", "Royal Ghost"), {"Battle Ram": 1.2, "Ram Rider": 1.2, "Bandit": 0.8, "Royal Ghost": 0.7, "Magic Archer": 0.5}, {}, {"bridge_pressure": 0.35}, 85),
    Rule("桥头冲锋", "桥头冲锋", ("Battle Ram", "Ram Rider"), (), (), {"Bandit": 0.8, "Royal Ghost": 0.7, "Magic Archer": 0.5, "Cannon Cart": 0.4}, {"P.E.K.K.A": 4.0, "Royal Recruits": 2.5}, {"bridge_pressure": 0.4}, 45),
    Rule("重装节奏", "桥头冲锋", ("Mega Knight", "P.E.K.K.A"), (), (), {"Miner": 0.4, "Goblin Barrel": 0.4, "Wall Breakers": 0.4, "Inferno Dragon": 0.4}, {"Battle Ram": 1.8, "Ram Rider": 1.8, "Royal Recruits": 2.0}, {"bridge_pressure": 0.15, "bait": 0.1}, 25),
    Rule("皇家卫队分路", "分路压制", ("Royal Recruits",), (), (), {"Royal Hogs": 1.2, "Flying Machine": 0.8, "Zappies": 0.8, "Goblin Cage": 0.5}, {}, {"split_lane": 0.4}, 88),
    Rule("三枪分路", "分路压制", ("Three Musketeers",), (), (), {"Battle Ram": 0.7, "Royal Ghost": 0.5, "Bandit": 0.5, "Elixir Collector": 0.8}, {}, {"split_lane": 0.25, "bridge_pressure": 0.15}, 82),
    Rule("皇家巨人推进", "重型推进", ("Royal Giant",), (), (), {"Fisherman": 0.8, "Hunter": 0.6, "Lightning": 0.5, "Phoenix": 0.4}, {}, {"heavy_support": 0.15}, 72),
    Rule("巨人推进", "重型推进", ("Giant",), (), (), {"Prince": 0.6, "Dark Prince": 0.5, "Graveyard": 0.5, "Sparky": 0.5}, {"Goblin Giant": 5.0, "Electro Giant": 5.0, "Royal Giant": 5.0}, {"heavy_support": 0.2}, 58),
    Rule("圣水戈仑推进", "重型推进", ("Elixir Golem",), (), (), {"Battle Healer": 0.9, "Night Witch": 0.7, "Rage": 0.7, "Electro Dragon": 0.6}, {}, {"heavy_support": 0.25}, 84),
    Rule("戈仑推进", "重型推进", ("Golem",), (), (), {"Night Witch": 0.9, "Lumberjack": 0.6, "Lightning": 0.6, "Baby Dragon": 0.5}, {}, {"heavy_support": 0.3}, 80),
    Rule("雷电巨人推进", "重型推进", ("Electro Giant",), (), (), {"Tornado": 0.9, "Lightning": 0.6, "Golden Knight": 0.5, "Bomber": 0.4}, {}, {"heavy_support": 0.25, "big_spell": 0.15}, 92),
    Rule("哥布林巨人推进", "重型推进", ("Goblin Giant",), (), (), {"Sparky": 0.9, "Prince": 0.5, "Dark Prince": 0.5, "Rage": 0.4}, {}, {"heavy_support": 0.2}, 78),
    Rule("天狗空军推进", "空中压制", ("Lava Hound",), (), (), {"Balloon": 1.0, "Skeleton Dragons": 0.7, "Mega Minion": 0.5, "Inferno Dragon": 0.5}, {}, {"air_support": 0.3}, 98),
    Rule("气球压制", "空中压制", ("Balloon",), (), (), {"Freeze": 0.8, "Lumberjack": 0.6, "Miner": 0.5, "Bowler": 0.4}, {"Lava Hound": 6.0}, {"air_support": 0.15, "cheap_cycle": 0.1}, 48),
)
CARDS = RuleSet(RULES, GROUPS, ANCHORS, 8)

#: Rules over part types, so that the adapter's baskets fall into several archetypes.
PARTS = RuleSet(
    (
        Rule("promo push", "push", ("PROMO",), (), ("LARGE", "MEDIUM"), {"LARGE": 0.8, "ECONOMY": 0.5}, {"SMALL": 4.0}, {"bulk": 0.25}, 80),
        Rule("small cycle", "cycle", ("SMALL",), (), (), {"ECONOMY": 0.75}, {"LARGE": 1.25}, {"light": 0.5}, 40),
        Rule("large control", "control", ("LARGE", "MEDIUM"), ("STANDARD",), (), {"ECONOMY": 0.25}, {}, {"bulk": 0.125}, 60),
    ),
    {"bulk": ("LARGE", "MEDIUM", "STANDARD"), "light": ("SMALL", "ECONOMY")},
    ("PROMO", "LARGE", "SMALL"),
    3,
)
