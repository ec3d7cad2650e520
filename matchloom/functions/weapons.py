"""Gun classes. A gun's place in its class is what the feed's icons mean."""

from __future__ import annotations

CLASSES = {
    "AR": ("M416", "AKM", "Beryl M762", "AUG A3", "Groza", "SCAR-L", "FAMAS", "G36C", "ACE32"),
    "SMG": ("PP19 Bison", "UMP45", "Micro Uzi", "Tommy Gun", "P90", "JS9", "Vector", "MP5K"),
    "Shotgun": ("DBS", "S12K", "S1897"),
    "LMG": ("M249", "MG3"),
    "Sniper": ("AWM",),
    "Grenade": ("Grenade",),
    "Molotov": ("Molotov",),
    "Melee": ("Pan",),
    "Vehicle": ("Car",),
}
GUNS = tuple(g for guns in CLASSES.values() for g in guns)
ZONE = "Zone"
